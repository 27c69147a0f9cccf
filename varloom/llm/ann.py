"""Approximate nearest neighbours by an inverted multi-index (operator 5).

Both halves of a vector are quantised by centroids of their own, so ``k``
centroids a half make ``k * k`` cells. A query walks the centroid pairs by the
sum of their inner products with its halves, best first, with a heap, until the
cells it passed hold the wanted share of all rows. The sum at which it stops
names the cells passed, so no list of cells travels. Their rows are reranked by
the exact inner product in double precision. Every row is indexed; centroids are
fitted on a bounded sample.

Defined cases: see :func:`varloom.llm.vectors.usable` for rows that take no
part; a repeated ``vec_id`` is one query but every row of it a candidate (never
for that id itself); ties go to the smaller ``vec_id``; with fewer candidates
all are returned; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.common import saved
from varloom.llm.vectors import QUERY_STEP, blocked, usable

NEAREST = 20
#: Rows k-means is fitted on, its rounds, and the largest number of centroids a half.
SAMPLE_ROWS, ROUNDS, MOST_CENTROIDS = 20_000, 12, 1_024
#: Rows an average cell holds, the share of all rows a query reranks, and at least so many rows.
CELL_ROWS, SHARE, LEAST = 0.5, 0.4, 400
#: Cells that one step of the walk passes.
STRIP = 16
#: Groups of first-half centroids, and rows and queries that one task compares.
GROUPS, ENTRY_BLOCK, PROBE_BLOCK = 16, 40_000, 4_000


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (centres**2).sum(1) - 2 * x @ centres.T
        label = near.argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        n = np.bincount(label, minlength=len(centres))
        full = n > 0
        centres[full] = sums[full] / n[full, None]
    return centres


def _matrix(column, dtype=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1)


def half_products(query: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = first.shape[1]
    return first @ query[:half], second @ query[half:]


def stopping_sum(a: np.ndarray, b: np.ndarray, counts: np.ndarray, wanted: int) -> float:
    """The least sum a[i] + b[j] of the best cells that together hold ``wanted`` rows.

    The cells of a first-half centroid, best first, are cut into strips; the heap
    holds the next strip of every centroid reached so far, by the least sum in
    it. A centroid enters when the first strip of the better one before it is
    passed. The strips passed hold enough rows; the exact sum lies among their cells.
    """
    by_first, by_second = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    ordered = counts[np.ix_(by_first, by_second)]
    starts = np.arange(0, len(b), STRIP)
    sizes = np.add.reduceat(ordered, starts, axis=1).tolist()
    tops, least = a[by_first].tolist(), b[by_second[np.minimum(starts + STRIP, len(b)) - 1]].tolist()
    heap, held, last = [(-(tops[0] + least[0]), 0, 0)], 0, np.inf
    while heap and held < wanted:
        negative, i, strip = heap[0]
        last = -negative
        held += sizes[i][strip]
        if strip + 1 < len(least):
            heapq.heapreplace(heap, (-(tops[i] + least[strip + 1]), i, strip + 1))
        else:
            heapq.heappop(heap)
        if not strip and i + 1 < len(tops):
            heapq.heappush(heap, (-(tops[i + 1] + least[0]), i + 1, 0))
    reached = np.count_nonzero(a >= last - b.max())
    sums = a[by_first[:reached], None] + b[by_second]
    passed = (sums >= last) & (ordered[:reached] > 0)
    sums, rows = sums[passed], ordered[:reached][passed]
    order = np.argsort(-sums, kind="stable")
    enough = min(np.searchsorted(np.cumsum(rows[order]), wanted), len(order) - 1)
    return sums[order[enough]] - 1e-12


def _assign(first: np.ndarray, second: np.ndarray):
    half = first.shape[1]

    def nearest(x, centres):
        return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1).astype(np.int32)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nearest(x[:, :half], first)), pa.array(nearest(x[:, half:], second)),
                 batch.column("vec_id"), batch.column("vector")],
                names=["i", "j", "vec_id", "vector"],
            )

    return run


def _walk(first, second, counts: np.ndarray, wanted: int):
    """One row per query and group of centroids that holds a cell the query passes."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, row, group, sums = _matrix(batch.column("vector")), [], [], []
            for k in range(len(x)):
                a, b = half_products(x[k], first, second)
                least = stopping_sum(a, b, counts, wanted)
                met = np.unique(np.flatnonzero(a + b.max() >= least) % GROUPS).tolist()
                row += [k] * len(met)
                group += met
                sums += [least] * len(met)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(group, pa.int32()), batch.column("vec_id").take(take), batch.column("vector").take(take),
                 pa.array(sums, pa.float64())],
                names=["g", "query_id", "query", "least"],
            )

    return run


def inner_products(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """In the order of the components, so that equal vectors tie exactly."""
    out = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        out += query[d] * rows[:, d]
    return out


def best(query: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact scores and ids of the ``k`` nearest rows, ties to the smaller id."""
    near = np.arange(len(rows))
    if len(rows) > k:
        rough = rows @ query
        near = np.flatnonzero(rough >= np.partition(rough, len(rows) - k)[len(rows) - k] - 1e-9 * max(1, np.abs(rough).max()))
    score = inner_products(query, rows[near])
    take = np.lexsort((ids[near], -score))[:k]
    return score[take], ids[near[take]]


def _rerank(first, second, k: int):
    def run(entries: pa.Table, probes: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if entries.num_rows and probes.num_rows:
            ids, i, j = (entries.column(c).to_numpy() for c in ("vec_id", "i", "j"))
            rows = _matrix(entries.column("vector"))
            query_ids, least = probes.column("query_id").to_numpy(), probes.column("least").to_numpy()
            for q, query in enumerate(_matrix(probes.column("query"))):
                a, b = half_products(query, first, second)
                passed = np.flatnonzero((a[i] + b[j] >= least[q]) & (ids != query_ids[q]))
                score, vec = best(query, rows[passed], ids[passed], k)
                out.append((np.full(len(vec), query_ids[q]), vec, score))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pa.table({
            "query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()),
            "score": pa.array(columns[2], pa.float64()),
        })

    return run


def nearest(
    table: DataFrame, k: int = NEAREST, share: float = SHARE, sample_rows: int = SAMPLE_ROWS,
    query_step: int = QUERY_STEP,
) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` largest inner products found for every query row."""
    rows = usable(table)
    schema = "query_id long, rank int, vec_id long, score double"
    n = rows.count()
    if n < 2:
        return table.sparkSession.createDataFrame([], schema)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vector").toArrow()
    x = _matrix(sample.column("vector"))
    x = x[np.lexsort(x.T)]  # the order in which tasks hand over the sample is open
    half = x.shape[1] // 2
    centres = int(min(MOST_CENTROIDS, max(1, np.ceil(np.sqrt(n / CELL_ROWS)))))
    first, second = k_means(x[:, :half], centres), k_means(x[:, half:], centres)
    index = saved(rows.mapInArrow(_assign(first, second), "i int, j int, vec_id long, vector array<float>"), "cells")
    counts = np.zeros((len(first), len(second)), np.int64)  # as large as MOST_CENTROIDS allows, whatever the table holds
    for r in index.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["i"], r["j"]] = r["n"]
    # the walk costs more than its few bytes tell: a stated number of tasks keeps them from being joined
    tasks = max(table.sparkSession.sparkContext.defaultParallelism, -(-n // (query_step * PROBE_BLOCK)))
    queries = (
        rows.where(F.pmod("vec_id", F.lit(query_step)) == 0).repartition(tasks, "vec_id")
        .groupBy("vec_id").agg(F.min("vector").alias("vector"))
    )
    wanted = max(LEAST, int(np.ceil(share * n)))
    probes = saved(
        queries.mapInArrow(
            _walk(first, second, counts, wanted), "g int, query_id long, query array<float>, least double"
        ),
        "probes",
    )
    found = blocked(
        index.withColumn("g", F.col("i") % GROUPS), probes, ["g"], "vec_id", "query_id", _rerank(first, second, k),
        "query_id long, vec_id long, score double", ENTRY_BLOCK, PROBE_BLOCK,
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
