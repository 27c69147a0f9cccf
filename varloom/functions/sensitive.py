"""Redaction of sensitive fields and scans for restricted content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom import constants as K
from varloom.functions import fields

REDACTED = "[REDACTED]"
DATA_SUFFIXES = (".csv", ".json", ".jsonl", ".tsv", ".txt", ".yaml", ".yml")


def is_sensitive(name: str) -> bool:
    return name != "event" and any(f in name.lower() for f in K.SENSITIVE_FRAGMENTS)


def redact(df: DataFrame) -> DataFrame:
    """Replace the values of columns with a sensitive name."""
    return df.select(
        *[F.lit(REDACTED).alias(c) if is_sensitive(c) else F.col(c) for c in df.columns]
    )


def redact_map(values: Column) -> Column:
    """Replace the values of map entries with a sensitive key."""
    return F.transform_values(
        values,
        lambda k, v: F.when(
            (k != "event") & fields.any_of([F.lower(k).contains(f) for f in K.SENSITIVE_FRAGMENTS]),
            F.lit(REDACTED),
        ).otherwise(v),
    )


def scan_sensitive(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """One row per finding: the other columns of ``df`` plus ``reason``.

    Without ``path`` the text rules run on every row; with it the path rules are
    added and the VCF rule applies to data-like suffixes only.
    """
    body = F.col(text)
    vcf = body.contains("##fileformat=VCF") & ~body.contains("##synthetic=true")
    rules: dict[str, Column] = {}
    if path is not None:
        lower = F.lower(path)
        parts = F.split(path, "/")
        rules["restricted/generated directory"] = F.arrays_overlap(
            parts, F.array(*[F.lit(d) for d in K.BLOCKED_DIRECTORIES])
        ) | F.col(path).startswith("runs/private/")
        rules["restricted genomic/data file type"] = fields.any_of(
            [lower.endswith(s) for s in K.BLOCKED_SUFFIXES]
        )
        vcf = vcf & fields.any_of([lower.endswith(s) for s in DATA_SUFFIXES])
    rules["VCF content without synthetic marker"] = vcf
    for label, pattern in K.SECRET_PATTERNS.items():
        rules[f"possible {label}"] = body.rlike(pattern)
    kept = [c for c in df.columns if c != text]
    return df.select(*kept, F.explode(fields.reasons(rules)).alias("reason"))


def extract_ids(
    df: DataFrame, key: str, text: str = "text", pattern: str = K.TERM_PATTERN,
    polarity: str = K.POLARITY_PATTERN,
) -> DataFrame:
    """Per document: the distinct ids of its table rows, and whether they may be used.

    ``df`` has one row per text row: ``key``, ``text`` and ``in_table``. ``ok`` is
    false when an id row states a polarity, when ids occur outside the table
    rows, or when there are none or more than 500.
    """
    ids = F.regexp_extract_all(text, F.lit(rf"\b({pattern})\b"), F.lit(1))
    found = df.select(
        key,
        "in_table",
        ids.alias("_ids"),
        (F.col("in_table") & (F.size(ids) > 0) & F.col(text).rlike(polarity)).alias("_polarity"),
    )
    marked = found.groupBy(key).agg(F.max("_polarity").alias("polarity"))
    single = (
        found.select(key, "in_table", F.explode("_ids").alias("id"))
        .groupBy(key, "id")
        .agg(F.max("in_table").alias("_in_table"))
    )
    # the id set of a document is cut after 501 ids by the count rule, not collected
    counts = single.groupBy(key).agg(
        F.count_if("_in_table").alias("table_ids"), F.count(F.lit(1)).alias("all_ids")
    )
    return marked.join(counts, key, "left").select(
        key,
        F.coalesce("table_ids", F.lit(0)).alias("table_ids"),
        F.coalesce("all_ids", F.lit(0)).alias("all_ids"),
        "polarity",
        (
            ~F.col("polarity")
            & (F.coalesce("table_ids", F.lit(0)) == F.coalesce("all_ids", F.lit(0)))
            & (F.coalesce("table_ids", F.lit(0)) >= 1)
        ).alias("ok"),
    )
