"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder():
    """crc32 of the id as text, modulo 5; 0 marks the rows held out from training."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))


def held_out():
    return F.coalesce(remainder() == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, cost=None) -> DataFrame:
    """(label, text) of at most ``rows`` labelled documents that are not held out.

    They are drawn evenly by a hash of the id; contradicting labels of one id
    count as the larger one. ``cost`` may be a condition a sampled text must meet.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(remainder() != 0)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    # only ids that are among the documents can be drawn
    drawn = (
        known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # the sample has a fixed bound of rows (an id and a label each)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    if cost is not None:
        sample = sample.where(cost)
    return sample.select("label", "text")
