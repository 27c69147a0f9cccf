"""What both vector searches share: usable vectors, and grouped search in bounded blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries are the rows whose id this number divides.
QUERY_STEP = 20


def usable(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part.

    Missing ids, missing or zero vectors, and vectors with missing or
    non-finite components take no part; nor do vectors of another dimension
    than most (ties: the larger one).
    """
    x = F.col(vector)
    fine = x.isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    ) & F.exists(x, lambda v: v != 0)
    rows = table.where(F.col("vec_id").isNotNull()).where(F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<float>").alias("vector")
    )
    most = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vector") == (most["n"] if most else 0))


def blocked(
    entries: DataFrame, probes: DataFrame, keys: list[str], entry_id: str, probe_id: str,
    search, schema: str, entry_rows: int, probe_rows: int,
) -> DataFrame:
    """Run ``search(entries, probes)`` for every key, cut into blocks of bounded size.

    A key with many entries or probes is split by a hash of their ids, and every
    block of its entries meets every block of its probes in a task of its own.
    """
    held = entries.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / entry_rows).alias("_e"))
    asked = probes.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / probe_rows).alias("_p"))
    sizes = F.broadcast(held.join(asked, keys))  # one row per key: the number of keys is a parameter
    zero = F.lit(0).cast("long")
    left = entries.join(sizes, keys).select(
        *entries.columns, F.pmod(F.xxhash64(entry_id), F.col("_e")).alias("_block"),
        F.explode(F.sequence(zero, F.col("_p") - 1)).alias("_chunk"),
    )
    right = probes.join(sizes, keys).select(
        *probes.columns, F.pmod(F.xxhash64(probe_id), F.col("_p")).alias("_chunk"),
        F.explode(F.sequence(zero, F.col("_e") - 1)).alias("_block"),
    )
    group = [*keys, "_block", "_chunk"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(search, schema)
