"""SQL names for the scalar library, as SQL functions (no Python in the row path)."""

from __future__ import annotations

from pyspark.sql import SparkSession

SQL_FUNCTIONS = {
    "gt_called(gt STRING)": (
        "BOOLEAN",
        "gt IS NOT NULL AND NOT (gt = '.' OR gt LIKE './%' OR gt LIKE '.|%' "
        "OR gt LIKE '%/.' OR gt LIKE '%|.')",
    ),
    "gt_is_ref(gt STRING)": ("BOOLEAN", "coalesce(gt IN ('0', '0/0', '0|0'), false)"),
    "canonical_contig(name STRING)": (
        "STRING",
        "CASE WHEN regexp_replace(name, '^chr', '') = 'M' THEN 'MT' "
        "WHEN regexp_replace(name, '^chr', '') RLIKE '^([1-9]|1[0-9]|2[0-2]|X|Y|MT)$' "
        "THEN regexp_replace(name, '^chr', '') END",
    ),
    "feature_quality(q DOUBLE)": (
        "DOUBLE",
        "CASE WHEN q IS NULL THEN 0.5D ELSE least(greatest(q / 100D, 0D), 1D) END",
    ),
    "feature_rarity(af DOUBLE)": (
        "DOUBLE",
        "CASE WHEN af IS NULL THEN 0.6D ELSE greatest(0D, 1D - least(af / 0.01D, 1D)) END",
    ),
    "candidate_key(allele STRING, gene_id STRING)": (
        "STRING",
        "concat(allele, '_g', substr(sha2(gene_id, 256), 1, 16))",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; they are inlined as expressions."""
    for signature, (returns, body) in SQL_FUNCTIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {returns} RETURN {body}"
        )
    return [s.split("(")[0] for s in SQL_FUNCTIONS]
