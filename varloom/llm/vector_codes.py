"""Product-quantised vector codes with exact integer arithmetic (operator 12).

Components become integers ``floor(4096 * x)``. A distance is
``|x|^2 - 2 x.c + |c|^2``; the dot products come from BLAS on float64 limbs:
integers are cut into limbs so small that every product of two limb matrices
stays below 2^53, and the limb products are put together in int64. So distances
are exact and the first minimum is the entry of the lowest index. Where int64 can
not hold a result, integers without bound take its place.

Every round of the fitting is one pass over the saved vectors: a task sums the
parts by (part, entry) and hands on one row of sums per (part, entry, position,
limb), so only the ``entries x components`` sums reach the driver. Nothing is
sampled and no group of rows meets in one task.

Defined cases: rows whose vector is missing or holds missing or non-finite
components are dropped; of the others, vectors of another length than most (ties:
the larger one) are dropped too. Zero vectors and empty ones stay. The first entries come from
the smallest ids (missing ids last, ties by vector), fewer if the table has fewer
rows. A length that the parts do not divide is cut as evenly as possible. Rows
with a missing id and repeated rows are coded like others. An error or label sum
beyond a long is missing. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import saved

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows one product compares.
STEP = 8_192
#: Partial sums travel in limbs of so many bits.
SUM_BITS = 60


def scaled(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): int64 where it fits, else Python integers; ``scale`` is a power of two."""
    x = np.asarray(x, np.float64)
    if not x.size or np.abs(x).max() < 2.0**62 / scale:
        return np.floor(x * scale).astype(np.int64)
    return np.frompyfunc(lambda v: (v.as_integer_ratio()[0] * scale) // v.as_integer_ratio()[1], 1, 1)(x)


def _bits(*arrays: np.ndarray) -> int:
    """Bits of the largest absolute value."""
    return max((int(abs(a).max()).bit_length() for a in arrays if a.size), default=0)


def limbs(x: np.ndarray, width: int, bits: int) -> list[np.ndarray]:
    """``x == sum(limb[i] << (width * i))``; all but the last limb are in [0, 2^width)."""
    out = []
    for _ in range(max(1, -(-bits // width)) - 1):
        out.append((x & ((1 << width) - 1)).astype(np.float64))
        x = x >> width
    return [*out, x.astype(np.float64)]


def dot_products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact ``x @ c.T`` of int64 matrices whose result fits int64."""
    length = max(1, x.shape[1])
    width = (53 - (length - 1).bit_length()) // 2 - 1
    left, right = limbs(x, width, _bits(x)), limbs(c, width, _bits(c))
    out = np.zeros((len(x), len(c)), np.int64)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            out += (a @ b.T).astype(np.int64) << (width * (i + j))
    return out


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all entries."""
    if x.dtype == object or c.dtype == object or 2 * _bits(x, c) + 2 + max(1, x.shape[1]).bit_length() > 62:
        wide = x.astype(object), c.astype(object)
        return ((wide[0][:, None, :] - wide[1][None]) ** 2).sum(-1)
    return (x * x).sum(1)[:, None] - 2 * dot_products(x, c) + (c * c).sum(1)[None]


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the first of several) and the squared distance."""
    d = distances(x, c)
    at = d.argmin(1)
    return at, d[np.arange(len(d)), at]


def cuts(length: int, parts: int) -> list[slice]:
    ends = [length * k // parts for k in range(parts + 1)]
    return [slice(a, b) for a, b in zip(ends, ends[1:])]


def _vectors(batch: pa.RecordBatch, length: int):
    """(first row, integers) of a batch, a few rows at a time."""
    column = batch.column("vector")
    for start in range(0, len(column), STEP):
        part = column.slice(start, STEP)
        yield start, scaled(part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), length))


def _sums(books: list[np.ndarray], length: int):
    """Counts and sums of the parts by (part, entry) over a whole task."""

    def run(batches):
        where, counts, sums = cuts(length, len(books)), [np.zeros(len(b), np.int64) for b in books], [0] * len(books)
        for batch in batches:
            for _, x in _vectors(batch, length):
                for p, (book, cut) in enumerate(zip(books, where)):
                    mine = x[:, cut]
                    at, _ = nearest(mine, book)
                    counts[p] += np.bincount(at, minlength=len(book))
                    of_entry = (at[None] == np.arange(len(book))[:, None]).astype(np.int64)
                    # a slice has 2^13 rows: its sums fit int64 where the integers have fewer than 50 bits
                    wide = mine.dtype == object or _bits(mine) > 49
                    part = of_entry.astype(object) @ mine.astype(object) if wide else of_entry @ mine
                    sums[p] = sums[p] + part.astype(object)
        rows = []
        for p, book in enumerate(books):
            for e in np.flatnonzero(counts[p]).tolist():
                rows.append((p, e, -1, 0, int(counts[p][e])))
                for d, value in enumerate(sums[p][e].tolist()):
                    sign, value, limb = (-1 if value < 0 else 1), abs(int(value)), 0
                    while value:
                        rows.append((p, e, d, limb, sign * (value & ((1 << SUM_BITS) - 1))))
                        value, limb = value >> SUM_BITS, limb + 1
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(),) * 4 + (pa.int64(),))],
            names=["part", "entry", "pos", "limb", "value"],
        )

    return run


def _refit(rows: DataFrame, books: list[np.ndarray], length: int) -> list[np.ndarray]:
    """One round: entries become the floored means of their parts; unused ones stay."""
    partial = rows.select("vector").mapInArrow(_sums(books, length), "part int, entry int, pos int, limb int, value long")
    total = partial.groupBy("part", "entry", "pos", "limb").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
    fresh = [b.astype(object) for b in books]
    counts: dict[tuple[int, int], int] = {}
    sums: dict[tuple[int, int, int], int] = {}
    for r in total.collect():  # entries x components rows, whatever the table holds
        if r["pos"] < 0:
            counts[r["part"], r["entry"]] = int(r["value"])
        else:
            key = (r["part"], r["entry"], r["pos"])
            sums[key] = sums.get(key, 0) + (int(r["value"]) << (SUM_BITS * r["limb"]))
    for (p, e), n in counts.items():
        for d in range(fresh[p].shape[1]):
            fresh[p][e, d] = sums.get((p, e, d), 0) // n
    return [_narrow(b) for b in fresh]


def _narrow(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if _bits(book) < 63 else book


def kept(table: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, label, vector) of the rows that are coded, saved, and the vectors' length."""
    x = F.col(f"`{vector}`")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = table.where(F.coalesce(x.isNotNull() & fine, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", x.cast("array<double>").alias("vector")
    )
    rows = saved(rows, "vectors")
    most = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = most["n"] if most else 0
    return rows.where(F.size("vector") == length), length


def codebooks(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """One matrix of integer entries per part."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = scaled(np.array([r["vector"] for r in first], np.float64).reshape(len(first), length))
    books = [_narrow(start[:, cut].astype(object)) for cut in cuts(length, parts)]
    for _ in range(rounds if first else 0):
        books = _refit(rows, books, length)
    return books


def _code(books: list[np.ndarray], length: int):
    most = 2**63 - 1

    def run(batches):
        where = cuts(length, len(books))
        for batch in batches:
            codes, errors = [], []
            for _, x in _vectors(batch, length):
                digits, error = np.empty((len(x), len(books)), np.uint8), np.zeros(len(x), object)
                for p, (book, cut) in enumerate(zip(books, where)):
                    digits[:, p], apart = nearest(x[:, cut], book)
                    error = error + apart.astype(object)
                codes += [row.tobytes().hex() for row in digits]
                errors += [e if e <= most else None for e in map(int, error)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    return run


def encode(rows: DataFrame, books: list[np.ndarray], length: int) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every row."""
    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(_code(books, length), f"vec_id long, label {label}, code string, error long")


def books_text(books: list[np.ndarray]) -> str:
    """All components by part, entry and position."""
    return ",".join(str(int(v)) for book in books for v in book.ravel().tolist())


def digest(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and the hash of the codebooks for every coded row."""
    rows, length = kept(table)
    books = codebooks(rows, length, parts, entries, rounds)
    coded = saved(encode(rows, books, length), "codes")
    # combined before the shuffle; a label that many rows share is one row here
    totals = coded.groupBy(F.col("label").alias("of")).agg(
        F.sum(F.col("error").cast("decimal(20,0)")).try_cast("long").alias("label_error"),
        F.count("error").alias("known"), F.count(F.lit(1)).alias("rows"),
    )
    whole = totals.select("of", F.when(F.col("known") == F.col("rows"), F.col("label_error")).alias("label_error"))
    printed = hashlib.sha256(books_text(books).encode()).hexdigest()
    return coded.join(whole, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(printed).alias("codebooks_sha256")
    )


def _oracle(rounds: int = ROUNDS) -> str:
    """The rounds written one after the other."""
    steps = [
        """
kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), comps AS MATERIALIZED (
  SELECT row, (k - 1) // (n // 8) AS part, (k - 1) % (n // 8) AS pos, CAST(floor(4096 * CAST(x AS DOUBLE)) AS HUGEINT) AS v
  FROM (SELECT row, len(embedding) AS n, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM kept)
), book0 AS MATERIALIZED (
  SELECT part, row - 1 AS entry, pos, v FROM comps WHERE row <= 16
)"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""apart{r} AS (
  SELECT row, part, entry, sum((c.v - b.v) * (c.v - b.v)) AS d FROM comps c JOIN book{r} b USING (part, pos) GROUP BY ALL
), near{r} AS MATERIALIZED (
  SELECT row, part, entry, d FROM apart{r} QUALIFY row_number() OVER (PARTITION BY row, part ORDER BY d, entry) = 1
)"""
        )
        if r < rounds:
            steps.append(
                f"""mean{r} AS (
  SELECT part, entry, pos, sum(v) AS s, count(*) AS n FROM comps JOIN near{r} USING (row, part) GROUP BY ALL
), book{r + 1} AS MATERIALIZED (
  SELECT part, entry, pos,
         CASE WHEN n IS NULL THEN b.v ELSE (s - ((s % n) + n) % n) // n END AS v
  FROM book{r} b LEFT JOIN mean{r} USING (part, entry, pos)
)"""
            )
    return (
        "WITH " + ", ".join(steps) + f""", coded AS (
  SELECT row, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY row
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (row)
"""
    )


ORACLE = _oracle()
