"""Helpers the operators share: saved tables, text batches, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.session import ensure_checkpoint_dir

#: Stands for a missing id inside an operator; orders after every real id.
NO_ID = 2**63 - 1
SLICE = 256


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it again.

    Cuts the lineage: what follows survives lost executors and reads the same rows.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_or_max(column="doc_id"):
    """The id as a long; a missing id counts as one document after all others."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def text_slices(batch: pa.RecordBatch, column: str, rows: int = SLICE) -> Iterator[tuple[int, list]]:
    """(first row, texts) of a batch, a few rows at a time; a missing text is empty."""
    values = batch.column(column)
    for start in range(0, len(values), rows):
        yield start, [x or "" for x in values.slice(start, rows).to_pylist()]


#: Bits of a bitmap of keys; its rows are bounded whatever the keys are.
BITS = 1 << 25


def bit_of(key: Column, bits: int = BITS) -> Column:
    """The bit a key sets; ``bits`` is a power of two."""
    return key.bitwiseAND(F.lit(bits - 1))


def bitmap(keys: DataFrame, key: Column, bits: int = BITS) -> DataFrame:
    """(slot, held): the bits of all keys, at most ``bits`` / 64 rows."""
    at = keys.select(bit_of(key, bits).alias("at"))
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    return at.groupBy(F.shiftright("at", 6).alias("slot")).agg(F.bit_or(bit).alias("held"))


def maybe_among(rows: DataFrame, held: DataFrame, key: Column, bits: int = BITS) -> DataFrame:
    """Semi-join with a bitmap: all rows whose key set a bit, and few others.

    For callers that drop the others later, so that the result does not depend on the
    number of bits; the bitmap has a fixed number of rows and is broadcast.
    """
    at = rows.withColumn("_bit", bit_of(key, bits))
    hit = F.expr("(held & shiftleft(1L, cast(_bit & 63 as int))) <> 0")
    return at.join(F.broadcast(held), (F.shiftright("_bit", 6) == F.col("slot")) & hit, "left_semi").drop("_bit")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b): rows (node, component), the smallest id reachable.

    Alternates large-star and small-star. Minima come from aggregates that
    combine before the shuffle and are joined back, so a hub's links never meet
    in one task; each round is saved, so a lost executor repeats one round only.
    """
    links = saved(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    before = None
    while True:
        state = links.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
        ).first()
        if before == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = (
            both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        roots = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(roots, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = saved(
            small.unionByName(roots.select("a", F.col("m").alias("b"))).distinct(), "links"
        )
