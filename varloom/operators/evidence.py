"""Evidence rows: payloads, keyed reduce, incremental merge and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom import constants as K
from varloom.operators.ordering import top_within
from varloom.session import require_empty

KEY = ["run_id", "variant_id", "gene", "method", "data_version"]
COLUMNS = [*KEY, "score", "known", "seq", "payload"]


def with_provenance(
    df: DataFrame,
    method: Column,
    tool_version: str,
    data_version: str,
    parameters: dict[str, str] | None = None,
    code_identity: str = "unversioned",
) -> DataFrame:
    """Add the provenance struct carried by every evidence row."""
    entries = [F.lit(x) for kv in (parameters or {}).items() for x in kv]
    params = F.create_map(*entries).cast("map<string,string>") if entries else F.create_map().cast(
        "map<string,string>"
    )
    return df.withColumn(
        "provenance",
        F.struct(
            F.lit(tool_version).alias("tool_version"),
            F.lit(data_version).alias("data_version"),
            method.alias("method"),
            params.alias("parameters"),
            F.lit(code_identity).alias("code_identity"),
            F.col("run_id").alias("run_id"),
        ),
    )


def to_payload(*columns: str | Column) -> Column:
    return F.to_json(F.struct(*columns))


def payload_field(payload: Column, path: str) -> Column:
    return F.get_json_object(payload, f"$.{path}")


def inheritance_evidence(rows: DataFrame, data_version: str, seq: Column) -> DataFrame:
    """Evidence rows from the single or pair pass (method, score, ...)."""
    extra = [c for c in rows.columns if c not in {"run_id", "variant_id", "gene", "row_id"}]
    tagged = with_provenance(rows, F.col("method"), "inheritance-v1", data_version)
    return tagged.select(
        "run_id",
        "variant_id",
        "gene",
        "method",
        F.lit(data_version).alias("data_version"),
        "score",
        F.lit(True).alias("known"),
        seq.alias("seq"),
        to_payload("variant_id", "gene", *extra, "provenance").alias("payload"),
    )


def phenotype_evidence(scores: DataFrame, data_version: str) -> DataFrame:
    """Evidence rows of gene scores; they belong to no single variant."""
    tagged = with_provenance(scores, F.lit(K.PHENOTYPE_METHOD), "phenotype-v1", data_version)
    return tagged.select(
        "run_id",
        F.lit("").alias("variant_id"),
        "gene",
        F.lit(K.PHENOTYPE_METHOD).alias("method"),
        F.lit(data_version).alias("data_version"),
        "score",
        "known",
        F.lit(0).cast("bigint").alias("seq"),
        to_payload("gene", "score", "association_count", "matched_terms", "provenance").alias(
            "payload"
        ),
    )


def mixed_versions(evidence: DataFrame) -> DataFrame:
    """(run, method) with more than one data version; must be empty."""
    return (
        evidence.groupBy("run_id", "method")
        .agg(F.min("data_version").alias("low"), F.max("data_version").alias("high"))
        .where("low <> high")
    )


def reduce_evidence(evidence: DataFrame, check_versions: bool = True) -> DataFrame:
    """One row per key: highest score, and of equal scores the last in ``seq``.

    A NULL score sorts below every score and never replaces one. ``max_by`` is
    partially aggregated before the shuffle, so repeated keys move once per task.
    """
    if check_versions:
        require_empty(mixed_versions(evidence), "mixed evidence data versions")
    rest = [c for c in evidence.columns if c not in KEY]
    return (
        evidence.groupBy(*KEY)
        .agg(F.max_by(F.struct(*rest), F.struct("score", "seq")).alias("_best"))
        .select(*KEY, *[F.col(f"_best.{c}").alias(c) for c in rest])
        .select(*evidence.columns)
    )


def merge_evidence(old: DataFrame, new: DataFrame, check_versions: bool = True) -> DataFrame:
    """Fold new rows into saved ones; the same reduce, as it is associative in ``seq``."""
    return reduce_evidence(old.unionByName(new), check_versions)


def best_gene_scores(evidence: DataFrame) -> DataFrame:
    return (
        evidence.where(F.col("method") == K.PHENOTYPE_METHOD)
        .groupBy("run_id", "gene")
        .agg(F.max("score").alias("phenotype_score"), F.max("known").alias("known"))
    )


def best_variant_scores(evidence: DataFrame) -> DataFrame:
    return (
        evidence.where(F.col("method") != K.PHENOTYPE_METHOD)
        .groupBy("run_id", "variant_id")
        .agg(F.max("score").alias("inheritance_score"))
    )


def model_summary(evidence: DataFrame, k: int = 5) -> DataFrame:
    """Per run and model: strong and uncertain counts, first ``k`` variants by score."""
    rows = evidence.where(F.col("method") != K.PHENOTYPE_METHOD)
    counts = rows.groupBy("run_id", "method").agg(
        F.count_if(F.col("score") >= K.STRONG_FIT).alias("strong_matches"),
        F.count_if((F.col("score") >= K.UNCERTAIN_FIT) & (F.col("score") < K.STRONG_FIT)).alias(
            "uncertain_matches"
        ),
    )
    first = top_within(
        rows.where(F.col("score") > 0).select("run_id", "method", "score", "variant_id"),
        ["run_id", "method"],
        [F.col("score").desc(), F.col("variant_id")],
        k,
        "_n",
    )
    tops = first.groupBy("run_id", "method").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_n", "variant_id"))), lambda x: x["variant_id"]
        ).alias("top_variant_ids")
    )
    return counts.join(tops, ["run_id", "method"], "left").withColumn(
        "top_variant_ids", F.coalesce("top_variant_ids", F.array().cast("array<string>"))
    )


def competing_models(evidence: DataFrame) -> DataFrame:
    """Variants with more than one strong model among the mutually exclusive ones."""
    return (
        evidence.where(
            F.col("method").isin(*K.EXCLUSIVE_MODELS) & (F.col("score") >= K.STRONG_FIT)
        )
        .groupBy("run_id", "variant_id")
        .agg(F.count(F.lit(1)).alias("models"))
        .where("models > 1")
    )


def top_genes(evidence: DataFrame, k: int) -> DataFrame:
    """First ``k`` genes per run by phenotype score, over the whole run's evidence."""
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = evidence.where(F.col("method") == K.PHENOTYPE_METHOD)
    return top_within(rows, ["run_id"], [F.col("score").desc(), F.col("gene")], k)


def evidence_rows(evidence: DataFrame, phenotype: bool, variant_id: str | None = None) -> DataFrame:
    """Evidence of one kind, ordered by gene, variant and method."""
    rows = evidence.where((F.col("method") == K.PHENOTYPE_METHOD) == F.lit(phenotype))
    if variant_id is not None:
        rows = rows.where(F.col("variant_id") == variant_id)
    return rows.orderBy("run_id", "gene", "variant_id", "method")
