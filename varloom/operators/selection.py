"""From ranked candidates to at most ten hypotheses per run, and their submission rows.

Spark does the wide part: anchors, incident pairs, one witness per source pair,
and everything about a pair that does not depend on earlier choices. Only the
order-dependent scan over at most 100 anchors of a run is a small Python step,
and its input per run is bounded.
"""

from __future__ import annotations

from decimal import Decimal, localcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varloom import constants as K
from varloom.functions import fields
from varloom.functions import genotype as G
from varloom.operators.ordering import checked_broadcast, top_within
from varloom.operators.pairs import GROUP, PAIR_BLOCK_ROWS, pair_candidates, pair_facts, phase_of
from varloom.operators.quality import duplicates
from varloom.session import materialize, require_empty

EPCR_FIRST, EPCR_DECAY = Decimal("0.1000"), Decimal("0.80")
# every consumed endpoint takes one coordinate; ten hypotheses take at most twenty
OPTIONS_PER_ANCHOR = 2 * K.MAX_HYPOTHESES + 1


def _epcr_values() -> list[Decimal]:
    with localcontext() as context:
        context.prec = 40
        return [EPCR_FIRST * EPCR_DECAY**n for n in range(K.MAX_HYPOTHESES)]


def epcr(rank: Column) -> Column:
    """Exact rank mass as decimal(38,22)."""
    table = {n: v for n, v in enumerate(_epcr_values(), 1)}
    pairs = [x for n, v in table.items() for x in (F.lit(n), F.lit(f"{v:f}").cast("decimal(38,22)"))]
    return F.create_map(*pairs)[rank.cast("int")]


def epcr_text(rank: Column) -> Column:
    """Plain decimal text of the rank mass, trailing zeros kept."""
    return fields.literal_map({n: f"{v:f}" for n, v in enumerate(_epcr_values(), 1)})[
        rank.cast("int")
    ]


def rank_of_mass(text: Column) -> Column:
    """The rank whose mass has this plain text; NULL for any other text."""
    return fields.literal_map({f"{v:f}": n for n, v in enumerate(_epcr_values(), 1)})[text]


def residual(count: Column) -> Column:
    """Mass left after the first ``count`` ranks, as plain decimal text."""
    left, table = Decimal(1), {0: "1"}
    with localcontext() as context:
        context.prec = 40
        for n, value in enumerate(_epcr_values(), 1):
            left -= value
            table[n] = f"{left:f}"
    return fields.literal_map(table)[count.cast("int")]


def base_ranks(ranking: DataFrame, mapping: DataFrame, context: str = K.BASE_MODE) -> DataFrame:
    """Best rank of every source allele."""
    rows = ranking.where(F.col("context") == context)
    return (
        rows.join(mapping.select("run_id", "variant_id", "allele_id"), ["run_id", "variant_id"])
        .groupBy("run_id", "allele_id")
        .agg(F.min("rank").alias("base_rank"))
    )


def anchors(ranks: DataFrame, limit: int = K.MAX_ANCHORS) -> DataFrame:
    """First source alleles of each run by (best rank, allele)."""
    return top_within(
        ranks, ["run_id"], [F.col("base_rank"), F.col("allele_id")], limit, "anchor_no"
    )


def endpoints(anchor_rows: DataFrame, incident: DataFrame) -> DataFrame:
    """(run_id, allele_id) of every anchor and every partner of one: all that a selection reads facts of."""
    partners = incident.select("run_id", F.col("partner").alias("allele_id"))
    return anchor_rows.select("run_id", "allele_id").unionByName(partners).distinct()


def source_candidates(
    mapping: DataFrame, alleles: DataFrame, variants: DataFrame, ranks: DataFrame, evidence: DataFrame
) -> DataFrame:
    """One row per source allele: coordinates, genes, genotype state, rank, de-novo support.

    The alleles are those of ``mapping``; it may hold the ``endpoints`` alone, ``ranks`` always hold all.
    An unranked allele gets rank n+1 (n = ranked candidates of the run) as a sort
    value only. De-novo support needs all three facts in the same evidence row.
    """
    per_variant = evidence.where(F.col("method") == "de_novo").select(
        "run_id",
        "variant_id",
        (
            F.col("known")
            & (F.col("score") > 0)
            & G.called_reference(F.get_json_object("payload", "$.mother_genotype"))
            & G.called_reference(F.get_json_object("payload", "$.father_genotype"))
            & (F.get_json_object("payload", "$.quality_checks_passed") == "true")
        ).alias("_de_novo"),
    )
    gene = F.upper(F.trim("gene"))
    joined = (
        mapping.select("run_id", "variant_id", "allele_id")
        .join(variants.select("run_id", "variant_id", "gene", "genotype"), ["run_id", "variant_id"])
        .join(per_variant, ["run_id", "variant_id"], "left")
    )
    grouped = joined.groupBy("run_id", "allele_id").agg(
        F.array_sort(
            F.collect_set(F.when(~gene.isin(*K.PLACEHOLDER_GENES), gene))
        ).alias("genes"),
        F.min("genotype").alias("_gt"),
        F.max("genotype").alias("_gt_high"),
        F.coalesce(F.max("_de_novo"), F.lit(False)).alias("de_novo_supported"),
    )
    same_call = F.when(
        F.col("_gt").eqNullSafe(F.col("_gt_high")), F.col("_gt")
    ).otherwise(F.raise_error(F.lit("calls of one allele disagree")).cast("string"))
    totals = ranks.groupBy("run_id").agg(F.count(F.lit(1)).alias("_ranked"))
    return (
        grouped.join(alleles, ["run_id", "allele_id"])
        .join(ranks, ["run_id", "allele_id"], "left")
        .join(totals, "run_id", "left")
        .select(
            "run_id",
            "allele_id",
            "chromosome",
            "position",
            "reference",
            "alternate",
            "genes",
            G.genotype_state(same_call).alias("state"),
            "de_novo_supported",
            F.col("base_rank").isNotNull().alias("ranked"),
            F.coalesce("base_rank", F.col("_ranked") + 1, F.lit(1)).alias("rank"),
        )
    )


def incident_pairs(anchor_rows: DataFrame, pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Saved pairs touching an anchor, one witness per (anchor, partner) source pair.

    The two ways a pair can touch an anchor are two equi-joins, not one OR join.
    The witness is the pair of highest confidence, then smallest ids; it is a
    partial aggregate, so repeated witnesses do not travel.
    """
    keys = mapping.select("run_id", "variant_id", "allele_id")
    a = keys.select("run_id", F.col("variant_id").alias("variant_a"), F.col("allele_id").alias("source_a"))
    b = keys.select("run_id", F.col("variant_id").alias("variant_b"), F.col("allele_id").alias("source_b"))
    mapped = pairs.join(a, ["run_id", "variant_a"], "left").join(b, ["run_id", "variant_b"], "left")
    wanted = anchor_rows.select("run_id", F.col("allele_id").alias("anchor"))
    shared = ["run_id", "variant_a", "variant_b", "gene", "phase", "confidence", "contradiction"]
    if "contradiction" not in pairs.columns:
        mapped = mapped.withColumn("contradiction", F.lit(False))
    as_first = mapped.select(*shared, F.col("source_a").alias("anchor"), F.col("source_b").alias("partner"))
    as_second = mapped.where("source_a <> source_b").select(
        *shared, F.col("source_b").alias("anchor"), F.col("source_a").alias("partner")
    )
    return witnesses(as_first.unionByName(as_second).join(wanted, ["run_id", "anchor"], "left_semi"))


def witnesses(touching: DataFrame) -> DataFrame:
    """One row per (anchor, partner): the pair of highest confidence, then smallest ids."""
    return (
        touching.groupBy("run_id", "anchor", "partner")
        .agg(
            F.min_by(
                F.struct("variant_a", "variant_b", "gene", "phase", "confidence", "contradiction"),
                F.struct(-F.col("confidence"), "variant_a", "variant_b"),
            ).alias("_w"),
            F.count(F.lit(1)).alias("saved_rows"),
        )
        .select("run_id", "anchor", "partner", "_w.*", "saved_rows")
    )


def anchor_pairs(
    trio: DataFrame, anchor_rows: DataFrame, mapping: DataFrame, block_rows: int = PAIR_BLOCK_ROWS
) -> DataFrame:
    """Pairs of every anchor with the other rows of its genes; the full pair list is never made.

    A star join: the few rows of the anchors (hubs, at most ``MAX_ANCHORS`` alleles of
    a run) meet the heterozygous rows of the same gene and chromosome. A gene above
    ``block_rows`` rows is cut into blocks, and the hubs are repeated once per block, so
    a hot gene spreads; the work is linear in the rows. Endpoints without a source
    allele take no part. Two anchors that pair meet from both sides.
    """
    facts = ["origin", "trio_quality", "decoded_genotype"]
    ends = (
        pair_candidates(pair_facts(trio)).where("_p_het").select(*GROUP, "variant_id", "row_id", *facts)
        .join(mapping.select("run_id", "variant_id", F.col("allele_id").alias("source")), ["run_id", "variant_id"])
    )
    ends = materialize(ends)
    wanted = materialize(anchor_rows.select("run_id", F.col("allele_id").alias("source")).distinct())
    hubs = ends.join(checked_broadcast(wanted), ["run_id", "source"], "left_semi")
    # only the sizes of genes that hold an anchor matter
    sizes = (
        ends.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n"))
        .join(hubs.select(*GROUP).distinct(), GROUP, "left_semi")
        .select(*GROUP, F.ceil(F.col("_n") / block_rows).alias("_blocks"))
    )
    sizes = materialize(sizes)
    hubs = hubs.join(checked_broadcast(sizes), GROUP).select(
        *GROUP, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"),
        *[F.col(c).alias(f"hub_{c}") for c in ("variant_id", "row_id", "source", *facts)],
    )
    spokes = ends.join(checked_broadcast(sizes), GROUP).withColumn("_block", F.pmod(F.xxhash64("row_id"), F.col("_blocks")))
    met = spokes.join(checked_broadcast(materialize(hubs)), [*GROUP, "_block"]).where(
        (F.col("hub_row_id") != F.col("row_id"))
        # the rows of one allele pair once
        & ((F.col("hub_source") != F.col("source")) | (F.col("hub_row_id") < F.col("row_id")))
    )
    sides = [
        {"origin": F.col(f"{side}origin"), "quality": F.col(f"{side}trio_quality"), "gt": F.col(f"{side}decoded_genotype")}
        for side in ("hub_", "")
    ]
    first = F.col("hub_row_id") < F.col("row_id")
    return met.withColumn("_phase", phase_of(*sides)).select(
        "run_id", F.col("hub_source").alias("anchor"), F.col("source").alias("partner"),
        F.when(first, F.col("hub_variant_id")).otherwise(F.col("variant_id")).alias("variant_a"),
        F.when(first, F.col("variant_id")).otherwise(F.col("hub_variant_id")).alias("variant_b"),
        F.trim("gene_key").alias("gene"), "_phase.phase", "_phase.confidence", F.lit(False).alias("contradiction"),
    )


def dedup_pairs(pairs: DataFrame) -> DataFrame:
    """Best witness of every unordered source pair: confidence, partner rank, then ids."""
    return (
        pairs.withColumn("pair_first", F.least("source_a", "source_b"))
        .withColumn("pair_second", F.greatest("source_a", "source_b"))
        .groupBy("run_id", "pair_first", "pair_second")
        .agg(
            F.min_by(
                F.struct(*[c for c in pairs.columns if c != "run_id"]),
                F.struct(-F.col("confidence"), "partner_rank", "variant_a", "variant_b"),
            ).alias("_w"),
            F.count(F.lit(1)).alias("witnesses"),
        )
        .select("run_id", "pair_first", "pair_second", "_w.*", "witnesses")
    )


def _sides(incident: DataFrame, candidates: DataFrame) -> DataFrame:
    """Incident pairs with the facts of both endpoints and the order key."""
    facts = candidates.select(
        "run_id",
        "allele_id",
        "rank",
        "genes",
        "state",
        fields.coordinate_key(
            F.col("chromosome"), F.col("position"), F.col("reference"), F.col("alternate")
        ).alias("coord"),
    )

    def side(name: str) -> DataFrame:
        return facts.select(
            "run_id",
            F.col("allele_id").alias(name),
            F.struct("rank", "genes", "state", "coord").alias(f"{name}_facts"),
        )

    joined = incident.join(side("anchor"), ["run_id", "anchor"]).join(
        side("partner"), ["run_id", "partner"]
    )
    return joined.withColumn(
        "order_key",
        F.struct(
            (-F.col("confidence")).alias("c"),
            F.col("partner_facts.rank").alias("r"),
            F.least("anchor", "partner").alias("first"),
            F.greatest("anchor", "partner").alias("second"),
            F.col("variant_a").alias("va"),
            F.col("variant_b").alias("vb"),
        ),
    )


def _static_rejection() -> tuple[Column, Column]:
    """Rejections before and after the test for consumed endpoints, in rule order."""
    a, p = F.col("anchor_facts"), F.col("partner_facts")
    before = F.when(F.col("anchor") == F.col("partner"), "rejected_pair_same_source_allele").when(
        a["coord"] == p["coord"], "rejected_pair_same_coordinates"
    )
    gene = F.upper(F.trim("gene"))
    after = (
        F.when(a["coord"]["chrom"] != p["coord"]["chrom"], "rejected_pair_different_chromosomes")
        .when(
            ~(F.array_contains(a["genes"], gene) & F.array_contains(p["genes"], gene)),
            "rejected_pair_gene_mismatch",
        )
        .when(
            (a["state"] != "heterozygous") | (p["state"] != "heterozygous"),
            "rejected_pair_nonheterozygous_call",
        )
        .when(F.col("contradiction"), "rejected_pair_observed_contradiction")
        .when(~F.col("phase").isin(*K.PAIR_PHASES), "rejected_pair_unsupported_phase")
    )
    return before, after


DECISION_SCHEMA = (
    "run_id string, anchor string, anchor_no bigint, reason string, searched boolean, "
    "submission_rank int, partner string, gene string, phase string, option int, "
    "consumed array<string>"
)


def _scan_run(frame):
    """Order-dependent scan of one run's anchors (at most 100 rows)."""
    import pandas as pd

    taken: set[str] = set()
    out = []
    chosen = 0
    for row in frame.sort_values("anchor_no").itertuples():
        if chosen == row.limit:
            break
        partner = None
        searched = False
        consumed = sorted(taken)
        if row.coord in taken:
            reason = "skipped_consumed_endpoint"
        elif row.state in ("reference", "unknown"):
            reason = f"unavailable_{row.state}_genotype"
        else:
            if row.singleton is not None:
                reason = row.singleton
            else:
                searched = True
                options = [] if row.options is None else row.options
                partner = next((o for o in options if o["coord"] not in taken), None)
                reason = (
                    "saved_compound_heterozygous_hypothesis"
                    if partner is not None
                    else "exploratory_singleton_no_eligible_saved_pair"
                )
            chosen += 1
            taken.add(row.coord)
            if partner is not None:
                taken.add(partner["coord"])
        accepted = not reason.startswith(("skipped", "unavailable"))
        out.append(
            (
                row.run_id,
                row.anchor,
                row.anchor_no,
                reason,
                searched,
                chosen if accepted else None,
                partner["partner"] if partner is not None else None,
                partner["gene"] if partner is not None else None,
                partner["phase"] if partner is not None else None,
                partner["no"] if partner is not None else None,
                consumed if searched else None,
            )
        )
    columns = [c.split()[0] for c in DECISION_SCHEMA.split(", ")]
    return pd.DataFrame(out, columns=columns).astype({"submission_rank": "Int32", "option": "Int32"})


def _coord_text(coord: Column) -> Column:
    return F.concat_ws(":", coord["chrom"], coord["pos"].cast("string"), coord["ref"], coord["alt"])


def select_hypotheses(
    anchor_rows: DataFrame,
    incident: DataFrame,
    candidates: DataFrame,
    limit: int = K.MAX_HYPOTHESES,
) -> dict[str, DataFrame]:
    """``hypotheses`` and ``audit`` of every run.

    An anchor only needs its first acceptable partner per coordinate, and only the
    first 21 of those: earlier hypotheses consume at most 20 coordinates, so one
    of them is always free if any partner is. The audit counts every rejected
    pair before the chosen one and is a plain aggregate over all incident pairs.
    """
    if not 1 <= limit <= K.MAX_HYPOTHESES:
        raise ValueError("select 1 to 10 hypotheses")
    before, after = _static_rejection()
    sides = materialize(
        _sides(incident, candidates)
        .withColumn("_before", before)
        .withColumn("_after", after)
        .withColumn("_coord", _coord_text(F.col("partner_facts.coord")))
        .select(
            "run_id", "anchor", "partner", "gene", "phase", "order_key", "_before", "_after", "_coord"
        )
    )
    free = sides.where(F.coalesce("_before", "_after").isNull())
    per_coord = free.groupBy("run_id", "anchor", "_coord").agg(
        F.min_by(F.struct("partner", "gene", "phase", "order_key"), "order_key").alias("o")
    )
    ordered = top_within(
        per_coord.select("run_id", "anchor", F.col("_coord").alias("coord"), "o.*"),
        ["run_id", "anchor"],
        [F.col("order_key")],
        OPTIONS_PER_ANCHOR,
        "no",
    )
    options = ordered.groupBy("run_id", "anchor").agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("no").cast("int").alias("no"), "coord", "partner", "gene", "phase"))
        ).alias("options")
    )
    facts = candidates.withColumn(
        "coord",
        _coord_text(
            fields.coordinate_key(
                F.col("chromosome"), F.col("position"), F.col("reference"), F.col("alternate")
            )
        ),
    ).select(
        "run_id",
        F.col("allele_id").alias("anchor"),
        "coord",
        "state",
        F.when(F.col("state") == "homozygous_alt", "homozygous_alternate_call")
        .when(F.col("state") == "haploid_alt", "haploid_alternate_call")
        .when(F.col("de_novo_supported"), "saved_de_novo_with_reference_parents_and_quality")
        .alias("singleton"),
    )
    scan_input = (
        anchor_rows.select("run_id", F.col("allele_id").alias("anchor"), "anchor_no")
        .join(facts, ["run_id", "anchor"])
        .join(options, ["run_id", "anchor"], "left")
        .withColumn("limit", F.lit(limit))
    )
    decisions = materialize(
        scan_input.groupBy("run_id").applyInPandas(_scan_run, DECISION_SCHEMA)
    )
    chosen_key = ordered.select("run_id", "anchor", F.col("no").cast("int").alias("option"), "order_key")
    searched = (
        decisions.where("searched")
        .select("run_id", "anchor", "option", "consumed")
        .join(chosen_key.withColumnRenamed("order_key", "_stop"), ["run_id", "anchor", "option"], "left")
        .drop("option")
    )
    seen = sides.join(checked_broadcast(materialize(searched)), ["run_id", "anchor"]).where(
        F.col("_stop").isNull() | (F.col("order_key") < F.col("_stop"))
    )
    rejected = (
        seen.withColumn(
            "reason",
            F.coalesce(
                "_before",
                F.when(F.array_contains("consumed", F.col("_coord")), "rejected_pair_consumed_endpoint"),
                "_after",
            ),
        )
        .where("reason is not null")
        .groupBy("run_id", "anchor", "reason")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    audit = rejected.unionByName(
        decisions.select("run_id", "anchor", "reason", F.lit(1).cast("bigint").alias("count"))
    )
    hypotheses = decisions.where("submission_rank is not null").select(
        "run_id", "submission_rank", F.col("anchor").alias("first"), F.col("partner").alias("second"),
        "reason", F.col("phase").alias("phase_status"), "gene",
    )
    return {"hypotheses": hypotheses, "audit": audit, "decisions": decisions}


def submission_rows(hypotheses: DataFrame, candidates: DataFrame, proband: DataFrame) -> DataFrame:
    """The 12 submission columns of every hypothesis (plus run_id and submission_rank)."""
    coords = candidates.select("run_id", "allele_id", "chromosome", "position", "reference", "alternate")

    def side(n: int, key: str) -> DataFrame:
        return coords.select(
            "run_id",
            F.col("allele_id").alias(key),
            F.col("chromosome").alias(f"chrom_{n}"),
            F.col("position").cast("string").alias(f"pos_{n}"),
            F.col("reference").alias(f"ref_{n}"),
            F.col("alternate").alias(f"alt_{n}"),
        )

    joined = (
        hypotheses.join(side(1, "first"), ["run_id", "first"])
        .join(side(2, "second"), ["run_id", "second"], "left")
        .join(proband.select("run_id", "proband_id"), "run_id")
    )
    head, rest = K.NOTES_TEMPLATE.split("{reason}")
    middle, tail = rest.split("{phase}")
    notes = F.concat(
        F.lit(head),
        F.col("reason"),
        F.lit(middle),
        F.coalesce("phase_status", F.lit("not_applicable")),
        F.lit(tail),
    )
    full = joined.withColumns(
        {
            "epcr": epcr_text(F.col("submission_rank")),
            "finding_type": F.lit("primary"),
            "notes": notes,
        }
    )
    blanks = {c: F.coalesce(c, F.lit("")) for c in ("chrom_2", "pos_2", "ref_2", "alt_2")}
    return full.withColumns(blanks).select("run_id", "submission_rank", *K.SUBMISSION_COLUMNS)


def submission_audit(hypotheses: DataFrame, alleles: DataFrame) -> DataFrame:
    """One row per endpoint of every hypothesis, with the coordinates of the saved source allele.

    Made from the source alleles, not from a draft, so a draft can be held against it.
    """
    ends = hypotheses.select(
        "run_id", "submission_rank",
        F.explode(
            F.array(
                F.struct(F.lit("first").alias("endpoint"), F.col("first").alias("source_id")),
                F.struct(F.lit("second").alias("endpoint"), F.col("second").alias("source_id")),
            )
        ).alias("e"),
    ).select("run_id", "submission_rank", "e.*").where("source_id is not null")
    saved = alleles.select(
        "run_id", F.col("allele_id").alias("source_id"), F.col("chromosome").alias("chrom"),
        F.col("position").cast("string").alias("pos"), F.col("reference").alias("ref"), F.col("alternate").alias("alt"),
    )
    # an endpoint without a saved allele stays, with missing coordinates, and fails the comparison
    return ends.join(saved, ["run_id", "source_id"], "left").withColumn("epcr", epcr_text(F.col("submission_rank")))


def validate_submission(rows: DataFrame, group: str = "run_id") -> DataFrame:
    """(group, reason) for submission files that break the input contract.

    ``row_no`` gives the file order. A file has at most 10 rows, and a larger one
    is reported by its count, so the only window runs over ``row_no`` of capped files.
    """
    second = ["chrom_2", "pos_2", "ref_2", "alt_2"]
    filled = sum((F.when(F.coalesce(c, F.lit("")) != "", 1).otherwise(0) for c in second), F.lit(0))

    def endpoint(n: int) -> Column:
        return F.concat_ws(
            ":",
            F.col(f"chrom_{n}"),
            F.regexp_replace(f"pos_{n}", "^0+", ""),
            F.upper(f"ref_{n}"),
            F.upper(f"alt_{n}"),
        )

    number = F.col("epcr").try_cast("double")
    value = F.when(~F.isnan(number), number)  # NaN would sort above every number
    structured = [c for c in K.SUBMISSION_COLUMNS if c != "notes"]
    control = fields.any_of(
        [F.coalesce(F.col(c), F.lit("")).rlike(r"[\x00-\x1f\x7f]|^ | $") for c in structured]
    )
    small = rows.join(
        rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.countDistinct("proband_id").alias("_probands")),
        group,
    )
    too_many = small.where("_n > 10").select(group, F.lit("row_count").alias("reason"))
    previous = F.lag(value).over(Window.partitionBy(group).orderBy("row_no"))
    checked = small.where("_n <= 10").withColumn("_prev", previous).withColumn("_filled", filled)
    bad_position = ~F.coalesce(F.col("pos_1").rlike("^[0-9]*[1-9][0-9]*$"), F.lit(False)) | (
        (F.col("_filled") == 4) & ~F.coalesce(F.col("pos_2").rlike("^[0-9]*[1-9][0-9]*$"), F.lit(False))
    )
    first_missing = fields.any_of(
        [F.coalesce(F.col(f"{c}_1"), F.lit("")) == "" for c in ("chrom", "pos", "ref", "alt")]
    )
    rules = {
        "several_probands": F.col("_probands") != 1,
        "incomplete_first_endpoint": first_missing,
        "incomplete_second_endpoint": ~F.col("_filled").isin(0, 4),
        "invalid_position": bad_position,
        "same_endpoints": (F.col("_filled") == 4) & (endpoint(1) == endpoint(2)),
        "invalid_epcr": ~F.coalesce((value > 0) & (value <= 1), F.lit(False)),
        "epcr_increases": F.coalesce(value > F.col("_prev"), F.lit(False)),
        "invalid_finding_type": ~F.coalesce(
            F.col("finding_type").isin("primary", "secondary"), F.lit(False)
        ),
        "control_characters": control,
    }
    per_row = checked.select(group, F.explode(fields.reasons(rules)).alias("reason"))
    candidate = F.array_join(
        F.array_sort(F.when(F.col("_filled") == 4, F.array(endpoint(1), endpoint(2))).otherwise(F.array(endpoint(1)))),
        "|",
    )
    repeated = duplicates(checked.withColumn("_candidate", candidate), [group, "_candidate"]).select(
        group, F.lit("duplicate_candidate").alias("reason")
    )
    return too_many.unionByName(per_row).unionByName(repeated).distinct()


def export_submission(draft: DataFrame, audit: DataFrame, check: bool = True) -> DataFrame:
    """Draft rows with presentation chromosome names, after they agree with the audit.

    ``audit`` (run_id, submission_rank, endpoint, source_id, chrom, pos, ref, alt, epcr).
    """
    sides = [
        draft.where(F.col(f"chrom_{n}") != "").select(
            "run_id",
            F.col("submission_rank"),
            F.lit(name).alias("endpoint"),
            F.col(f"chrom_{n}").alias("chrom"),
            F.col(f"pos_{n}").alias("pos"),
            F.col(f"ref_{n}").alias("ref"),
            F.col(f"alt_{n}").alias("alt"),
            "epcr",
        )
        for n, name in ((1, "first"), (2, "second"))
    ]
    drafted = sides[0].unionByName(sides[1])
    if check:
        from varloom.operators.quality import row_difference

        columns = drafted.columns
        require_empty(row_difference(drafted, audit.select(*columns)), "draft and audit differ")
        require_empty(duplicates(audit, ["run_id", "source_id"]), "source allele used twice")
        coordinate = fields.coordinate_key(
            F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")
        )
        require_empty(
            duplicates(audit.withColumn("_c", coordinate), ["run_id", "_c"]), "coordinate used twice"
        )
    return draft.withColumns(
        {
            "chrom_1": fields.present_chrom(F.col("chrom_1")),
            "chrom_2": F.when(F.col("chrom_2") == "", "").otherwise(
                fields.present_chrom(F.col("chrom_2"))
            ),
        }
    )


def reconcile_saved(
    variants: DataFrame, mapping: DataFrame, alleles: DataFrame, evidence: DataFrame
) -> DataFrame:
    """Candidates whose saved tables disagree: coordinates, calls, gene or evidence."""
    key = ["run_id", "variant_id"]
    a = alleles.select(
        "run_id",
        "allele_id",
        *[F.col(c).alias(f"_a_{c}") for c in ("chromosome", "position", "reference", "alternate")],
        F.col("genotype").alias("_a_genotype"),
        F.col("disposition").alias("_disposition"),
    )
    expected_gene = F.upper(F.trim(F.coalesce(F.nullif("gene_symbol", F.lit("")), "gene_id", F.lit(""))))
    expected_gene = F.when(expected_gene == "UNASSIGNED", "UNKNOWN").otherwise(expected_gene)
    ev = evidence.where(F.col("method") != K.PHENOTYPE_METHOD).select(
        *key,
        F.col("gene").alias("_e_gene"),
        "method",
        F.get_json_object("payload", "$.gene").alias("_p_gene"),
        F.get_json_object("payload", "$.method").alias("_p_method"),
        F.get_json_object("payload", "$.variant_id").alias("_p_variant"),
        F.get_json_object("payload", "$.proband_genotype").alias("_p_genotype"),
    )
    base = variants.join(mapping, key, "left").join(a, ["run_id", "allele_id"], "left")
    gene = F.upper(F.trim(F.coalesce("gene", F.lit(""))))
    row_rules = {
        "allele_missing": F.col("_disposition").isNull(),
        "allele_not_included": F.coalesce(F.col("_disposition") != "included", F.lit(False)),
        "coordinates_differ": fields.any_of(
            [
                ~F.col(c).eqNullSafe(F.col(f"_a_{c}"))
                for c in ("chromosome", "position", "reference", "alternate")
            ]
        ),
        "genotype_differs": ~F.col("genotype").eqNullSafe(F.col("_a_genotype")),
        "gene_differs": gene != expected_gene,
    }
    rows = base.select(*key, F.explode(fields.reasons(row_rules)).alias("reason"))
    joined = variants.select(*key, "genotype", gene.alias("_gene")).join(ev, key)
    evidence_rules = {
        "evidence_gene_differs": ~F.col("_e_gene").eqNullSafe(F.col("_gene"))
        | ~F.col("_p_gene").eqNullSafe(F.col("_gene")),
        "evidence_method_differs": ~F.col("_p_method").eqNullSafe(F.col("method")),
        "evidence_variant_differs": ~F.col("_p_variant").eqNullSafe(F.col("variant_id")),
        "evidence_genotype_differs": ~F.col("_p_genotype").eqNullSafe(F.col("genotype")),
    }
    return rows.unionByName(
        joined.select(*key, F.explode(fields.reasons(evidence_rules)).alias("reason"))
    ).distinct()
