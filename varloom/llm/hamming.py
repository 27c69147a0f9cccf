"""Exact top-k search of binary codes by incremental multi-index hashing (operator 10).

A 64-bit code is cut into four segments of 16 bits. In round ``r`` every open
query looks at the codes that differ in exactly ``r`` bits in some segment and
verifies whole distances. After it, all codes within distance 4 * (r + 1) - 1
have been seen, so a query closes as soon as its k-th distance is within that.

Equal codes are one entry with their smallest ids, which is all that a top k can
use. The tables of a segment are dealt by the leading bits of its values; a
query goes only to the parts its radius can reach. Large parts and many queries
are cut into blocks.

Defined cases: see :func:`varloom.llm.vectors.usable` for rows that take no
part; a repeated ``vec_id`` with several codes is searched by its smallest code
and found by each; a query never returns its own id; ties go to the smaller
``vec_id``; with fewer candidates all are returned; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.common import saved
from varloom.llm.vectors import QUERY_STEP, blocked, usable

NEAREST = 10
SEGMENTS, WIDTH = 4, 16
#: Codes a part of a segment holds on average, and the most leading bits that name a part.
PART_ROWS, MOST_BITS = 256, 12
ENTRY_BLOCK, PROBE_BLOCK = 100_000, 20_000
_FAR = 65


def sign_codes(batches):
    """The signs of the first 64 components as bits of a long (component 0 is the highest)."""
    for batch in batches:
        codes = []
        for vector in batch.column("vector").to_pylist():
            bits = np.zeros(64, np.uint8)
            head = np.array(vector[:64]) > 0
            bits[: len(head)] = head
            codes.append(int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(codes, pa.int64())], names=["vec_id", "code"])


def _segment(code: np.ndarray, s: int) -> np.ndarray:
    return (code.view(np.uint64) >> np.uint64(48 - WIDTH * s)) & np.uint64(0xFFFF)


def _deal(bits: int):
    """One row per code and segment: the part that holds it."""

    def run(batches):
        for batch in batches:
            code = batch.column("code").to_numpy()
            for s in range(SEGMENTS):
                part = (_segment(code, s) >> np.uint64(WIDTH - bits)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(code), s, np.int32)), pa.array(part),
                     batch.column("code"), batch.column("least_id")],
                    names=["s", "part", "code", "least_id"],
                )

    return run


def _reach(bits: int, radius: int):
    """One row per query, segment and part that its radius can reach."""
    parts = np.arange(1 << bits, dtype=np.uint64)

    def run(batches):
        for batch in batches:
            code = batch.column("code").to_numpy()
            for s in range(SEGMENTS):
                own = _segment(code, s) >> np.uint64(WIDTH - bits)
                for at in range(0, len(code), 1024):
                    apart = np.bitwise_count(own[at : at + 1024, None] ^ parts[None])
                    # the bits below the part can differ in at most WIDTH - bits places
                    q, p = np.nonzero((apart <= radius) & (radius - apart.astype(np.int64) <= WIDTH - bits))
                    take = pa.array(q + at, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(q), s, np.int32)), pa.array(p.astype(np.int32)),
                         batch.column("code").take(take), batch.column("bound").take(take)],
                        names=["s", "part", "query", "bound"],
                    )

    return run


def _verify(radius: int, keep: int):
    def run(entries: pa.Table, probes: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if entries.num_rows and probes.num_rows:
            s = entries.column("s")[0].as_py()
            code, least = entries.column("code").to_numpy(), entries.column("least_id").to_numpy()
            query, bound = probes.column("query").to_numpy(), probes.column("bound").to_numpy()
            mine, theirs = _segment(query, s), _segment(code, s)
            step = max(1, 4_000_000 // len(code))
            for at in range(0, len(query), step):
                shell = np.bitwise_count(mine[at : at + step, None] ^ theirs[None]) == radius
                q, e = np.nonzero(shell)
                apart = np.bitwise_count(query[at + q].view(np.uint64) ^ code[e].view(np.uint64)).astype(np.int32)
                near = apart <= bound[at + q]
                q, e, apart = q[near], e[near], apart[near]
                order = np.lexsort((least[e], apart, q))
                q, e, apart = q[order], e[order], apart[order]
                first = np.searchsorted(q, q)
                top = np.arange(len(q)) - first < keep
                out.append((query[at + q[top]], code[e[top]], least[e[top]], apart[top]))
        empty = [np.zeros(0, np.int64)] * 4
        columns = [np.concatenate(c) for c in zip(*out)] if out else empty
        return pa.table({
            "query": pa.array(columns[0], pa.int64()), "code": pa.array(columns[1], pa.int64()),
            "least_id": pa.array(columns[2], pa.int64()), "distance": pa.array(columns[3], pa.int32()),
        })

    return run


def _ids(codes: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` smallest ids of every code; the limit is applied before the shuffle."""
    order = Window.partitionBy("code").orderBy("vec_id")
    return codes.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)


def search(codes: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, distance of the ``k`` nearest codes of every query row (vec_id, code)."""
    keep = k + 1  # a query's own id may be among them
    ids = saved(_ids(codes, keep), "code-ids")
    classes = saved(ids.groupBy("code").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "codes")
    bits = int(min(MOST_BITS, max(0, np.ceil(np.log2(max(1, classes.count()) / PART_ROWS)))))
    tables = saved(
        classes.select("code", "least_id").mapInArrow(_deal(bits), "s int, part int, code long, least_id long"), "segments"
    )
    own = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("code").alias("query"))
    open_queries = own.select(F.col("query").alias("code"), F.lit(_FAR).alias("bound")).distinct()
    best, closed = None, None
    for radius in range(WIDTH + 1):
        probes = open_queries.mapInArrow(_reach(bits, radius), "s int, part int, query long, bound int")
        found = blocked(
            tables, probes, ["s", "part"], "code", "query", _verify(radius, keep),
            "query long, code long, least_id long, distance int", ENTRY_BLOCK, PROBE_BLOCK,
        )
        if best is not None:
            found = found.unionByName(best)
        found = found.distinct()  # a code may be found through several segments
        order = Window.partitionBy("query").orderBy("distance", "least_id")
        found = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n")
        best = saved(found, "nearest")
        # distance at which the codes so far hold enough ids
        running = Window.partitionBy("query").orderBy("distance").rangeBetween(Window.unboundedPreceding, 0)
        counted = best.join(classes.select("code", "n"), "code").withColumn("_held", F.sum("n").over(running))
        bounds = counted.where(F.col("_held") >= keep).groupBy("query").agg(F.min("distance").alias("bound"))
        covered = SEGMENTS * (radius + 1) - 1
        state = saved(
            open_queries.select(F.col("code").alias("query")).join(bounds, "query", "left")
            .select(F.col("query").alias("code"), F.coalesce("bound", F.lit(_FAR)).alias("bound")),
            "open",
        )
        ready = state.where(F.col("bound") <= covered).select("code")
        done = best.join(ready.select(F.col("code").alias("query")), "query", "left_semi")
        closed = done if closed is None else closed.unionByName(done)
        open_queries = state.where(F.col("bound") > covered)
        best = best.join(open_queries.select(F.col("code").alias("query")), "query", "left_semi")
        if radius == WIDTH or open_queries.isEmpty():
            break
    closed = closed.unionByName(best)  # fewer rows than asked for: all were seen
    pairs = (
        own.join(closed.select("query", "code", "distance"), "query")
        .join(ids.select("code", "vec_id"), "code").where("vec_id <> query_id")
        .groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance"))
    )
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return (
        pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "distance")
    )


def nearest_signs(table: DataFrame, k: int = NEAREST, query_step: int = QUERY_STEP) -> DataFrame:
    """Top ``k`` by Hamming distance between sign codes, for the rows whose id ``query_step`` divides."""
    codes = saved(usable(table).mapInArrow(sign_codes, "vec_id long, code long"), "signs")
    return search(codes, codes.where(F.pmod("vec_id", F.lit(query_step)) == 0), k)


ORACLE = r"""
WITH usable AS (
  SELECT DISTINCT vec_id, [x > 0 FOR x IN embedding] AS bits FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(len(list_filter(list_zip(q.bits, c.bits), lambda p: p[1] <> p[2])) AS INTEGER) AS distance
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank,
       vec_id, distance
FROM pairs QUALIFY rank <= 10
"""
