"""Cleaning and packing of the documents table, stage by stage.

Every stage reads what its predecessor wrote and passes on what it keeps, with
the columns of ``documents``; the last one returns the packed pieces. Rows with a
missing ``doc_id`` and missing texts go through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import line_dedup, near_dedup, packing, quality, toxicity
from varloom.session import ensure_checkpoint_dir


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _plain(docs: DataFrame) -> DataFrame:
    """The documents with all columns but ``doc_id`` and ``text`` under names that no operator uses."""
    columns = [
        F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"given{i}") for i, c in enumerate(docs.columns)
    ]
    return docs.select(*columns)


def _named(rows: DataFrame, docs: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``docs`` again, in their order."""
    changed = changed or {}
    columns = [
        changed[c].alias(c) if c in changed else F.col(c if c in ("doc_id", "text") else f"given{i}").alias(c)
        for i, c in enumerate(docs.columns)
    ]
    return rows.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half."""
    plain = _plain(docs)
    machine = toxicity.train(plain, _labels(spark, sf_dir))
    return _named(toxicity.score(plain, machine, plain.columns).where("_toxicity < 0.5"), docs)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality reaches the threshold."""
    plain = _plain(docs)
    field = quality.train(plain, _labels(spark, sf_dir))
    return _named(quality.score(plain, field, plain.columns).where(F.col("_quality") >= quality.THRESHOLD), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; lines that an earlier document holds are taken out of the text."""
    kept = line_dedup.drop_lines(_plain(docs))
    length = F.char_length("_kept").cast(docs.schema["n_chars"].dataType)
    return _named(kept, docs, {"text": F.col("_kept"), "n_chars": length})


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Of a document that is there several times one row is kept; texts that are no
    near copies stay, whatever their doc_id.
    """
    kept = near_dedup.grouped(docs.select("doc_id", "text")).where("kept and doc_id is not null")
    alone = F.when(F.col("group").isNull(), F.col("text_key"))  # texts without shingles have no group
    kept = kept.groupBy("doc_id", "group", alone.alias("alone")).agg(F.min("text_key").alias("_text_key"))
    kept = kept.select(F.col("doc_id").alias("_id"), "_text_key")
    keyed = _plain(docs).where("doc_id is not null").withColumn("_text_key", near_dedup.text_key())
    keyed = keyed.withColumn("_id", F.col("doc_id").cast("long"))
    named = keyed.join(kept, ["_id", "_text_key"], "left_semi").dropDuplicates(["_id", "_text_key"])
    return _named(named.drop("_id", "_text_key").unionByName(_plain(docs).where("doc_id is null")), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, placed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("packing", pack_sequences),
]

#: The learned stages cannot be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
