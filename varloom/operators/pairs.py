"""Same-gene heterozygous pairs.

Two forms. ``het_pairs`` lists every pair (``pair_work`` counts them exactly
beforehand); a large gene is cut into blocks, so its pairs spread over many
tasks. ``compound_best`` needs no pair list: how well two variants pair
depends only on a few facts per variant (parental origin, quality, phase), so a
gene group is first reduced to its few classes of partners and every variant
then meets the classes. Its cost is linear in the rows, whatever a gene holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom import constants as K
from varloom.operators.inheritance import apply_caps, parental_origin
from varloom.operators.ordering import checked_broadcast, top_within
from varloom.session import dbl, materialize

#: Rows of a gene group that are paired in one block.
PAIR_BLOCK_ROWS = 500
GROUP = ["run_id", "gene_key", "chromosome"]


def pair_candidates(variants: DataFrame) -> DataFrame:
    """Rows that may enter a pair: heterozygous, with a chromosome and a known gene.

    ``gene_key`` is the untrimmed upper-case gene (the join key); the
    placeholder test uses the trimmed one.
    """
    known = ~F.upper(F.trim("gene")).isin(*K.PLACEHOLDER_GENES)
    return variants.where(
        F.col("genotype").isin(*K.HET_GENOTYPES) & F.col("chromosome").isNotNull() & known
    ).withColumn("gene_key", F.upper("gene"))


def pair_work(variants: DataFrame) -> DataFrame:
    """Exact number of pairs per run; decimal arithmetic cannot overflow."""
    return (
        pair_candidates(variants)
        .groupBy(*GROUP)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("run_id")
        .agg(
            F.sum(F.expr("cast(n as decimal(19,0)) * (n - 1) div 2")).alias("pairs"),
            F.max("n").alias("largest_group"),
        )
    )


def het_pairs(variants: DataFrame, carry: list[str], block_rows: int = PAIR_BLOCK_ROWS) -> DataFrame:
    """All unordered pairs (first source row < second) inside a gene and chromosome.

    ``carry`` columns travel with both endpoints as ``<name>_a`` / ``<name>_b``,
    so no second join fetches them. A group above ``block_rows`` rows is cut into
    blocks by a hash of the row, and every ordered pair of blocks has a join key
    of its own, so no task holds more than the pairs of two blocks.
    """
    wanted = list(dict.fromkeys(["variant_id", "row_id", *carry]))
    side = pair_candidates(variants).select(*GROUP, *wanted)
    large = (
        side.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows)
        .select(*GROUP, F.ceil(F.col("_n") / block_rows).alias("_blocks"))
    )
    cut = (
        side.join(checked_broadcast(materialize(large)), GROUP, "left")
        .withColumn("_blocks", F.coalesce("_blocks", F.lit(1).cast("long")))
        .withColumn("_own", F.pmod(F.xxhash64("row_id"), F.col("_blocks")))
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    )
    a = cut.select(
        *GROUP, F.col("_own").alias("_block_a"), F.col("_other").alias("_block_b"),
        *[F.col(c).alias(f"{c}_a") for c in wanted],
    )
    b = cut.select(
        *GROUP, F.col("_other").alias("_block_a"), F.col("_own").alias("_block_b"),
        *[F.col(c).alias(f"{c}_b") for c in wanted],
    )
    return (
        a.join(b, [*GROUP, "_block_a", "_block_b"])
        .where(F.col("row_id_a") < F.col("row_id_b"))
        .drop("_block_a", "_block_b")
    )


def phase_of(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Struct(phase, confidence) of two heterozygous calls.

    Each side gives ``origin``, ``quality`` (trio quality passed) and ``gt``.
    """
    known_a, known_b = a["origin"] != "unknown", b["origin"] != "unknown"
    opposite = known_a & known_b & (a["origin"] != b["origin"])
    phased = a["gt"].contains("|") & b["gt"].contains("|") & (a["gt"] != b["gt"])

    def result(phase: str, confidence: float) -> Column:
        return F.struct(F.lit(phase).alias("phase"), dbl(confidence).alias("confidence"))

    return (
        F.when(opposite & a["quality"] & b["quality"], result("confirmed_trans", 0.95))
        .when(opposite, result("possible_trans", 0.5))
        .when(known_a & known_b, result("unknown", 0.25))
        .when(known_a | known_b, result("possible_trans", 0.65))
        .when(phased, result("possible_trans", 0.7))
        .otherwise(result("unknown", 0.55))
    )


def pair_facts(trio: DataFrame) -> DataFrame:
    """Columns a pair needs from a variant with its trio calls."""
    return trio.withColumn("origin", parental_origin()).withColumn(
        "decoded_genotype", F.col("_p.genotype")
    )


def pair_phase(trio: DataFrame) -> DataFrame:
    """Saved pair rows: endpoints, gene, phase and confidence.

    The pair list tests the row genotype; a pair is kept only when the decoded
    calls of both endpoints are heterozygous too.
    """
    carry = ["origin", "trio_quality", "decoded_genotype", "_p_het"]
    pairs = het_pairs(pair_facts(trio), carry)
    sides = [
        {
            "origin": F.col(f"origin_{s}"),
            "quality": F.col(f"trio_quality_{s}"),
            "gt": F.col(f"decoded_genotype_{s}"),
        }
        for s in "ab"
    ]
    return (
        pairs.where(F.col("_p_het_a") & F.col("_p_het_b"))
        .withColumn("_phase", phase_of(*sides))
        .select(
            "run_id",
            F.col("variant_id_a").alias("variant_a"),
            F.col("variant_id_b").alias("variant_b"),
            "row_id_a",
            "row_id_b",
            F.trim("gene_key").alias("gene"),
            "chromosome",
            "_phase.phase",
            "_phase.confidence",
        )
    )


def partner_classes(trio: DataFrame) -> DataFrame:
    """Per gene group, the two last partners of every class of partners.

    Two are enough: when a variant is itself the last of its class, the other
    one is its last partner. The array has a fixed bound (classes x 2).
    """
    facts = (
        pair_candidates(pair_facts(trio))
        .where("_p_het")
        .select(
            *GROUP,
            "origin",
            F.col("trio_quality").alias("quality"),
            F.when(F.col("decoded_genotype").contains("|"), F.col("decoded_genotype"))
            .otherwise(F.lit("unphased"))
            .alias("gt"),
            "row_id",
            "variant_id",
        )
    )
    last = top_within(
        facts, [*GROUP, "origin", "quality", "gt"], [F.col("row_id").desc()], 2, "_n"
    )
    return last.groupBy(*GROUP).agg(
        F.collect_list(F.struct("origin", "quality", "gt", "row_id", "variant_id")).alias("classes")
    )


def compound_best(trio: DataFrame) -> DataFrame:
    """Add ``compound``: the best compound-heterozygous evidence of each variant.

    Struct(score, partner_row, partner, phase); NULL without a partner. Of equal
    scores the pair last in source order wins, as in the evidence reduce.
    """
    facts = pair_facts(trio)
    eligible = (
        F.col("genotype").isin(*K.HET_GENOTYPES)
        & F.col("_p_het")
        & F.col("chromosome").isNotNull()
        & ~F.upper(F.trim("gene")).isin(*K.PLACEHOLDER_GENES)
    )
    # a row that cannot pair gets a key of its own, so such rows spread evenly
    own_key = F.concat(F.lit("\u0001"), F.col("row_id").cast("string"))
    keyed = facts.withColumn(
        "gene_key", F.when(F.coalesce(eligible, F.lit(False)), F.upper("gene")).otherwise(own_key)
    )
    joined = keyed.join(partner_classes(trio), GROUP, "left")
    own = {
        "origin": F.col("origin"),
        "quality": F.col("trio_quality"),
        "gt": F.col("decoded_genotype"),
    }

    def scored(partner: Column) -> Column:
        other = {k: partner[k] for k in ("origin", "quality", "gt")}
        pair = phase_of(own, other)
        return F.struct(
            apply_caps(pair["confidence"], F.col("trio_quality")).alias("score"),
            partner["row_id"].alias("partner_row"),
            partner["variant_id"].alias("partner"),
            pair["phase"].alias("phase"),
        )

    others = F.filter("classes", lambda c: c["row_id"] != F.col("row_id"))
    best = F.array_max(F.transform(others, scored))
    return joined.withColumn("compound", best).drop("classes", "gene_key")


def inheritance_table(trio: DataFrame) -> DataFrame:
    """All six models per variant in one row (wide form).

    ``autosomal_recessive`` is the better of homozygous and compound evidence.
    """
    from varloom.operators.inheritance import single_fits

    both = compound_best(single_fits(trio))
    compound = F.col("compound.score")
    recessive = F.greatest(F.col("homozygous_recessive"), compound)  # greatest skips NULL
    return both.withColumn("compound_heterozygous", compound).withColumn(
        "autosomal_recessive", apply_caps(recessive, F.col("trio_quality"))
    )


def pair_evidence(trio: DataFrame) -> DataFrame:
    """Long form of the pair pass: compound and recessive rows per paired variant."""
    table = inheritance_table(trio).where(F.col("compound").isNotNull())
    rows = F.array(
        F.struct(
            F.lit("compound_heterozygous").alias("method"),
            F.col("compound_heterozygous").alias("score"),
        ),
        F.struct(
            F.lit("autosomal_recessive").alias("method"),
            F.col("autosomal_recessive").alias("score"),
        ),
    )
    return table.select(
        "run_id",
        "variant_id",
        F.upper("gene").alias("gene"),
        "row_id",
        F.col("compound.partner").alias("partner"),
        F.col("compound.phase").alias("phase"),
        F.col("trio_quality").alias("quality_checks_passed"),
        F.explode(rows).alias("e"),
    ).select("*", "e.*").drop("e")
