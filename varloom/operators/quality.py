"""Checks as violation tables: an empty result means the rule holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom import constants as K
from varloom.functions import fields
from varloom.functions import genotype as G
from varloom.operators.ordering import checked_broadcast
from varloom.session import materialize


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def row_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Multiset difference of two tables: rows with the surplus on the left (+) or right (-).

    One aggregation over both sides instead of two EXCEPT ALL passes.
    """
    columns = left.columns
    signed = left.withColumn("_s", F.lit(1)).unionByName(right.withColumn("_s", F.lit(-1)))
    return (
        signed.groupBy(*columns).agg(F.sum("_s").alias("surplus")).where(F.col("surplus") != 0)
    )


def set_mismatch(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are not exactly once on both sides, with both counts."""
    signed = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    return (
        signed.groupBy(*keys)
        .agg(F.sum("_l").alias("left_rows"), F.sum("_r").alias("right_rows"))
        .where("left_rows <> 1 or right_rows <> 1")
    )


def lookup_mismatch(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left keys without exactly one matching row on the right."""
    counts = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"))
    return (
        left.select(*keys)
        .distinct()
        .join(counts, keys, "left")
        .withColumn("matches", F.coalesce("matches", F.lit(0)))
        .where("matches <> 1")
    )


def join_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that stops the job unless every left row finds exactly one right row."""
    packed = right.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.any_value(F.struct(*[c for c in right.columns if c not in keys])).alias("_row"),
    )
    joined = left.join(packed, keys, "left")
    checked = F.when(F.col("_n") == 1, F.col("_row")).otherwise(
        F.raise_error(F.concat(F.lit("no single match for "), F.to_json(F.struct(*keys))))
    )
    return joined.withColumn("_row", checked).select(*left.columns, "_row.*")


def mixed_contexts(sources: DataFrame, fields_: list[str], key: str = "run_id") -> DataFrame:
    """Runs whose inputs do not share one value of every context field, or have none."""
    aggs = [
        x
        for f in fields_
        for x in (F.min(f).alias(f"{f}_min"), F.max(f).alias(f"{f}_max"), F.count_if(F.col(f).isNull()).alias(f"{f}_null"))
    ]
    broken = fields.any_of(
        [
            (F.col(f"{f}_min") != F.col(f"{f}_max")) | (F.col(f"{f}_null") > 0)
            for f in fields_
        ]
    )
    rules = {
        f: (F.col(f"{f}_min") != F.col(f"{f}_max")) | (F.col(f"{f}_null") > 0) for f in fields_
    }
    return (
        sources.groupBy(key)
        .agg(*aggs)
        .where(F.coalesce(broken, F.lit(True)))
        .select(key, fields.reasons(rules).alias("fields"))
    )


def unknown_builds(sources: DataFrame, allowed: list[str]) -> DataFrame:
    """Inputs with a genome build outside the allowed list."""
    return sources.where(~F.coalesce(F.col("genome_build").isin(*allowed), F.lit(False)))


def in_par(chromosome: Column, position: Column, intervals: dict[str, list[tuple[int, int]]]) -> Column:
    """True when a position lies in a listed interval of its contig (inclusive)."""
    hits = [
        (chromosome == contig) & position.between(first, last)
        for contig, spans in intervals.items()
        for first, last in spans
    ]
    return F.coalesce(fields.any_of(hits), F.lit(False)) if hits else F.lit(False)


def in_intervals(df: DataFrame, intervals: DataFrame) -> DataFrame:
    """Add ``in_par`` from an interval table (chromosome, intervals array<struct<first,last>>).

    One row per contig on the right, so the join adds no rows; a contig's
    intervals are a short list.
    """
    return df.join(intervals, "chromosome", "left").withColumn(
        "in_par",
        F.coalesce(
            F.exists(
                "intervals",
                lambda x: (F.col("position") >= x["first"]) & (F.col("position") <= x["last"]),
            ),
            F.lit(False),
        ),
    ).drop("intervals")


PREFLIGHT_RULES = (
    "duplicate_variant_id",
    "unsupported_contig",
    "invalid_position",
    "unnormalized_allele",
    "missing_annotation",
    "sample_set_differs",
    "proband_genotype_differs",
    "genotype_quality_missing",
    "genotype_not_biallelic",
    "sex_unknown_on_sex_chromosome",
    "ploidy_mismatch",
    "called_y_in_female",
)


def preflight(
    variants: DataFrame,
    individuals: DataFrame,
    roles: DataFrame,
    par: dict[str, list[tuple[int, int]]],
    allow_missing_annotations: bool = False,
) -> DataFrame:
    """Per run: records, missing calls and annotations, rows breaking each rule, and warnings.

    The pedigree arrives as one row per run, behind a check of its size; the calls of a
    variant are checked in place. Only the test for repeated ids shuffles them, without
    other columns.
    """
    people = individuals.groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.struct("id", "sex"))).alias("_sex")
    ).join(roles.select("run_id", "proband_id"), "run_id", "full_outer")
    joined = variants.join(checked_broadcast(materialize(people)), "run_id", "left")
    contig = fields.strip_chr(F.coalesce("chromosome", F.lit("")))
    facts = joined.withColumns(
        {
            "_contig": contig,
            "_par": in_par(contig, F.col("position"), par),
            "_entries": F.map_entries(F.coalesce("calls", F.create_map().cast(G.CALLS_TYPE))),
        }
    )
    on_sex = F.col("_contig").isin("X", "Y")

    def any_call(test) -> Column:
        return F.exists("_entries", lambda e: F.coalesce(test(e), F.lit(False)))

    def gt(entry) -> Column:
        return entry["value"]["genotype"]

    def sex(entry) -> Column:
        return F.coalesce(F.col("_sex")[entry["key"]], F.lit("unknown"))

    def expected(entry) -> Column:
        haploid = (F.col("_contig") == "MT") | (
            on_sex & (sex(entry) == "male") & ~F.col("_par")
        )
        return F.when(haploid, 1).otherwise(2)

    missing_fields = [
        F.col(c).isNull() | (F.col(c).cast("string") == "")
        for c in ("gene", "transcript", "consequence", "allele_frequency")
        if c in variants.columns
    ]
    missing = sum((m.cast("int") for m in missing_fields), F.lit(0))
    sequence = r"^[ACGT]+$"
    rules = {
        "unsupported_contig": ~F.col("_contig").isin(*K.STANDARD_CONTIGS),
        "invalid_position": F.col("position").isNull()
        | (F.col("position") <= 0)
        | F.col("variant_id").isNull()
        | (F.col("variant_id") == ""),
        "unnormalized_allele": ~F.coalesce(
            F.upper("reference").rlike(sequence) & F.upper("alternate").rlike(sequence), F.lit(False)
        ),
        "missing_annotation": F.lit(False) if allow_missing_annotations else missing > 0,
        "sample_set_differs": F.array_sort(F.map_keys("calls"))
        != F.array_sort(F.map_keys("_sex")),
        "proband_genotype_differs": ~F.col("genotype").eqNullSafe(
            F.col("calls")[F.col("proband_id")]["genotype"]
        ),
        "genotype_quality_missing": any_call(lambda e: e["value"]["quality"].isNull()),
        "genotype_not_biallelic": any_call(
            lambda e: F.exists(G.alleles(gt(e)), lambda a: ~a.isin("0", "1", "."))
        ),
        "sex_unknown_on_sex_chromosome": on_sex & any_call(lambda e: sex(e) == "unknown"),
        "ploidy_mismatch": any_call(
            lambda e: G.gt_called(gt(e)) & (F.size(G.alleles(gt(e))) != expected(e))
        ),
        "called_y_in_female": (F.col("_contig") == "Y")
        & any_call(lambda e: (sex(e) == "female") & G.gt_called(gt(e))),
    }
    report = facts.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(F.size(F.filter("_entries", lambda e: ~G.gt_called(gt(e))))).alias(
            "missing_genotypes"
        ),
        F.sum(missing).alias("missing_annotations"),
        *[F.count_if(F.coalesce(rules[name], F.lit(True))).alias(name) for name in PREFLIGHT_RULES if name in rules],
    )
    repeated = duplicates(variants.select("run_id", "variant_id"), ["run_id", "variant_id"]).groupBy("run_id").agg(
        F.sum(F.col("n") - 1).alias("duplicate_variant_id")
    )
    warnings = {"missing_calls_not_imputed": F.col("missing_genotypes") > 0, "annotations_missing": F.col("missing_annotations") > 0}
    return (
        report.join(repeated, "run_id", "left")
        .withColumn("duplicate_variant_id", F.coalesce("duplicate_variant_id", F.lit(0)))
        .withColumn("warnings", fields.reasons(warnings))
    )


#: Names that pin no release.
UNPINNED = ("latest", "main", "unknown")
MOST_SAMPLES = 1_000


def context_violations(specs: DataFrame, individuals: DataFrame, records: DataFrame) -> DataFrame:
    """(run_id, reason): faults in what a run says about its input.

    ``specs``: run_id, genome_build, annotation_build, normalized_biallelic, reference_checksum,
    transcript_release, sample_ids array, par_intervals map of contig to array of
    (first, last). ``records`` (run_id, ...) are its variants: a run needs at least one.
    """
    listed = individuals.groupBy("run_id").agg(F.array_sort(F.collect_set("id")).alias("_ids"))
    filled = records.select("run_id").distinct().withColumn("_filled", F.lit(True))
    facts = specs.join(listed, "run_id", "left").join(filled, "run_id", "left")
    samples = F.coalesce("sample_ids", F.array().cast("array<string>"))
    spans = F.flatten(F.map_values("par_intervals"))
    contigs = F.map_keys("par_intervals")
    known = lambda c: F.coalesce(F.col(c).isin("GRCh37", "GRCh38"), F.lit(False))
    rules = {
        "unknown_build": ~known("genome_build") | ~known("annotation_build"),
        "builds_differ": F.coalesce(F.col("genome_build") != F.col("annotation_build"), F.lit(False)),
        "not_normalized": ~F.coalesce("normalized_biallelic", F.lit(False)),
        "invalid_reference_checksum": ~F.coalesce(F.col("reference_checksum").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "transcript_release_not_pinned": F.coalesce(
            (F.col("transcript_release") == "") | F.lower("transcript_release").isin(*UNPINNED), F.lit(True)
        ),
        "sample_count": ~F.size(samples).between(1, MOST_SAMPLES),
        "duplicate_samples": F.size(F.array_distinct(samples)) != F.size(samples),
        "samples_differ_from_pedigree": ~F.array_sort(F.array_distinct(samples)).eqNullSafe(F.coalesce("_ids", F.array().cast("array<string>"))),
        "par_intervals_missing": ~F.coalesce(F.array_contains(contigs, "X") & F.array_contains(contigs, "Y"), F.lit(False)),
        "invalid_par_intervals": F.coalesce(
            F.exists(contigs, lambda c: ~c.isin("X", "Y")) | F.exists(spans, lambda x: (x["first"] < 1) | (x["last"] < x["first"])),
            F.lit(False),
        ),
        "no_records": F.col("_filled").isNull(),
    }
    return facts.select("run_id", F.explode(fields.reasons(rules)).alias("reason"))


def preflight_failures(report: DataFrame) -> DataFrame:
    """Runs of a preflight report that break a rule, with the rules broken."""
    rules = {name: F.col(name) > 0 for name in PREFLIGHT_RULES}
    return report.select("run_id", fields.reasons(rules).alias("broken")).where(F.size("broken") > 0)


def pedigree_violations(individuals: DataFrame, roles: DataFrame) -> DataFrame:
    """(run_id, reason) for every broken pedigree rule, apart from ancestry cycles.

    Keys are (run, individual); the checks are counts and anti-joins.
    """
    ids = individuals.select("run_id", F.col("id"))
    role_links = roles.select(
        "run_id",
        F.col("proband_id").alias("child"),
        F.explode(F.array("mother_id", "father_id")).alias("parent"),
    )
    own_links = individuals.select(
        "run_id",
        F.col("id").alias("child"),
        F.explode(F.array("mother_id", "father_id")).alias("parent"),
    )
    links = role_links.unionByName(own_links).where("parent is not null")
    known = ids.withColumnRenamed("id", "parent").distinct()
    parts = [
        duplicates(ids, ["run_id", "id"]).select("run_id", F.lit("duplicate_individual").alias("reason")),
        individuals.groupBy("run_id").count().where(F.col("count") > K.MAX_INDIVIDUALS).select(
            "run_id", F.lit("pedigree_too_large").alias("reason")
        ),
        roles.join(ids.withColumnRenamed("id", "proband_id"), ["run_id", "proband_id"], "left_anti").select(
            "run_id", F.lit("unknown_proband").alias("reason")
        ),
        links.join(known, ["run_id", "parent"], "left_anti").select(
            "run_id", F.lit("unknown_parent").alias("reason")
        ),
        links.where("child = parent").select("run_id", F.lit("self_parent").alias("reason")),
        roles.where("mother_id = father_id").select("run_id", F.lit("parents_not_distinct").alias("reason")),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.distinct()


def pedigree_cycles(individuals: DataFrame, roles: DataFrame) -> DataFrame:
    """Individuals that are their own ancestor."""
    from varloom.operators.ontology import cyclic_terms

    name = lambda c: F.concat_ws("\u0001", "run_id", c)
    own = individuals.select(
        name("id").alias("hpo_id"),
        F.array_compact(
            F.array(
                F.when(F.col("mother_id").isNotNull(), name("mother_id")),
                F.when(F.col("father_id").isNotNull(), name("father_id")),
            )
        ).alias("parents"),
    )
    by_role = roles.select(
        name("proband_id").alias("hpo_id"),
        F.array_compact(
            F.array(
                F.when(F.col("mother_id").isNotNull(), name("mother_id")),
                F.when(F.col("father_id").isNotNull(), name("father_id")),
            )
        ).alias("parents"),
    )
    cyclic = cyclic_terms(own.unionByName(by_role))
    parts = F.split("term", "\u0001")
    return cyclic.select(parts[0].alias("run_id"), parts[1].alias("id"))


def interval_breaks(segments: DataFrame, partition: list[str] | None = None) -> DataFrame:
    """Breaks in the interval cover of a source: (keys, boundary, reason).

    Segments must start at row 1 and continue each other without gap or overlap,
    and a segment's length must equal its record count. Every boundary is one
    aggregate over the starts and ends that meet there, so no ordered pass over
    a whole source is needed.
    """
    keys = partition or []
    marks = segments.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("first_row").alias("boundary"), F.lit(1).alias("s"), F.lit(0).alias("e")),
                F.struct((F.col("last_row") + 1).alias("boundary"), F.lit(0).alias("s"), F.lit(1).alias("e")),
            )
        ).alias("m"),
    )
    met = marks.groupBy(*keys, "m.boundary").agg(
        F.sum("m.s").alias("starts"), F.sum("m.e").alias("ends")
    )
    first = F.col("boundary") == 1
    rules = {
        "gap": ~first & (F.col("starts") >= 1) & (F.col("ends") == 0),
        "overlap": (F.col("starts") > 1) | (F.col("ends") > 1) | (first & (F.col("ends") > 0)),
    }
    broken = met.select(*keys, "boundary", F.explode(fields.reasons(rules)).alias("reason"))
    lengths = segments.where(
        (F.col("last_row") - F.col("first_row") + 1) != F.col("records")
    ).select(*keys, F.col("first_row").alias("boundary"), F.lit("length_differs").alias("reason"))
    return broken.unionByName(lengths)
