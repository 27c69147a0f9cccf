"""MinHash near-duplicate detection with tensored banding (operator 2).

Two collections of ``BANDS`` half keys are computed per document, each from
``HASHES`` minhashes. Every pair of a half key of the first and one of the
second collection is a table key, so ``2 * BANDS * HASHES`` minhashes serve
``BANDS ** 2`` tables. A pair of similarity 0.75 is missed with probability
about 2 * (1 - 0.75 ** HASHES) ** BANDS (3.5e-4 at the defaults, less above).

Documents with equal sets are one class from the start. Table keys only say
which classes may be linked: buckets are joined to their smallest member, never
listed as pairs. The full sets of the candidates that hang together are then
compared exactly, in tasks of bounded size: a larger candidate cluster is cut
into blocks, and every pair of blocks is one task. A task tests one document
against all others that share one of its rare shingles, skips what is connected
already, and returns a spanning forest, not the links.

Defined cases: missing, empty and blank texts have no shingles and link with
nothing; rows that share a ``doc_id`` are compared by their own texts; a missing
``doc_id`` takes no part, has no component and is kept; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import bitmap, components, maybe_among, saved, text_slices

WORDS = 5
BANDS = 11
HASHES = 2
#: Shingles one comparing task holds (of each of two blocks).
BLOCK_SHINGLES = 1_000_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_CACHE = 100_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_SHIFT = np.uint64(29)


class Shingler:
    """Distinct 64-bit shingle hashes of a text, sorted."""

    def __init__(self, words: int = WORDS):
        self.words, self.seen = words, {}

    def _hash(self, word: str) -> int:
        value = self.seen.get(word)
        if value is None:
            if len(self.seen) >= _CACHE:
                self.seen.clear()
            value = self.seen[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def __call__(self, text: str) -> np.ndarray:
        found = _WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())
        hashes = np.fromiter(map(self._hash, found), np.uint64, len(found))
        length = min(self.words, len(hashes))
        if not length:
            return hashes
        n = len(hashes) - length + 1
        mixed = hashes[:n] ^ np.uint64(length)
        for k in range(1, length):
            mixed = (mixed ^ (mixed >> _SHIFT)) * _ODD[k % 4] + hashes[k : k + n]
        mixed = (mixed ^ (mixed >> _SHIFT)) * _ODD[0]
        mixed.sort()
        if len(mixed) > 1:
            mixed = mixed[np.concatenate(([True], mixed[1:] != mixed[:-1]))]
        return mixed


def _coefficients(count: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (
        rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
        rng.integers(0, 2**63, count, dtype=np.uint64),
    )


def half_keys(shingles: np.ndarray, bands: int, hashes: int, odd, add) -> np.ndarray:
    """``2 * bands`` half keys, each from ``hashes`` minhashes of the set."""
    least = np.empty(2 * bands * hashes, np.uint64)
    for k in range(len(least)):
        x = shingles * odd[k] + add[k]
        least[k] = (x ^ (x >> _SHIFT)).min()
    grouped = least.reshape(2 * bands, hashes)
    key = grouped[:, 0].copy()
    for k in range(1, hashes):
        key = (key ^ (key >> _SHIFT)) * _ODD[1] + grouped[:, k]
    return (key * _ODD[2]).view(np.int64)


def _sketcher(bands: int, hashes: int, words: int):
    def run(batches):
        shingler = Shingler(words)
        odd, add = _coefficients(2 * bands * hashes)
        for batch in batches:
            counts, prints, keys = [], [], []
            for _, texts in text_slices(batch, "text"):
                for text in texts:
                    s = shingler(text)
                    counts.append(len(s))
                    prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    keys.append(half_keys(s, bands, hashes, odd, add) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_key"), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "n_shingles", "print", "halves"],
            )

    return run


def text_key():
    """Tells the texts of rows that share a ``doc_id`` apart."""
    return F.xxhash64("text")


def sketches(docs: DataFrame, bands: int = BANDS, hashes: int = HASHES, words: int = WORDS) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, a print of the whole set, and the half keys of both collections."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text").mapInArrow(
        _sketcher(bands, hashes, words), "doc_id long, text_key long, n_shingles long, print binary, halves array<long>"
    )


def candidate_links(classes: DataFrame, bands: int = BANDS) -> DataFrame:
    """Links (a, b) of every class to the smallest class of each of its table buckets.

    Two classes share a table key only if they share both of its half keys, so half keys
    that one class holds alone are left out before the pairs are formed.
    """
    halves = classes.select("node", F.posexplode("halves").alias("i", "half")).select(
        "node", "i", F.xxhash64("i", "half").alias("half")
    )
    shared = halves.groupBy("half").agg(F.min("node").alias("low"), F.max("node").alias("top")).where("low < top").select("half")
    # at most 2 * bands halves of a class
    sides = halves.join(shared, "half", "left_semi").groupBy("node").agg(
        F.collect_list(F.when(F.col("i") < bands, F.col("half"))).alias("first"),
        F.collect_list(F.when(F.col("i") >= bands, F.col("half"))).alias("second"),
    )
    keys = sides.select("node", "second", F.explode("first").alias("one")).select("node", "one", F.explode("second").alias("two"))
    keys = keys.select("node", F.xxhash64("one", "two").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b < top")
    return keys.join(buckets.select("key", "b"), "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _shingle_rows(words: int):
    def run(batches):
        shingler = Shingler(words)
        for batch in batches:
            for start, texts in text_slices(batch, "text"):
                sets = [shingler(t).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(start, len(texts)) for c in ("cluster", "blocks", "side", "node")),
                     pa.array(sets, pa.binary())],
                    names=["cluster", "blocks", "side", "node", "shingles"],
                )

    return run


def linked(a: int, b: int, both: np.ndarray) -> np.ndarray:
    """100 * intersection >= 75 * union, in integers."""
    return 100 * both >= 75 * (a + b - both)


def spanning_forest(sets: list[np.ndarray], sides: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect exactly what the links of similarity 0.75 connect.

    ``sides`` numbers the block of each set; with two blocks only links across
    them are wanted. One document is tested against every other that shares one
    of its rarest shingles (a linked pair shares at least one of those); the
    largest connected part needs no tests of its own.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    items = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    distinct, code = np.unique(items, return_inverse=True)
    by_code = np.argsort(code, kind="stable")
    posting = owner[by_code]
    ends = np.cumsum(np.bincount(code, minlength=len(distinct)))
    begins = ends - np.bincount(code, minlength=len(distinct))
    counts = ends - begins
    firsts = np.cumsum(sizes) - sizes
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    across = len(np.unique(sides)) > 1
    links, done, size = [], np.zeros(n, bool), np.ones(n, np.int64)
    largest = 0
    # large sets first; a document in the largest part needs no test, since in the
    # end all documents outside that part were tested against everything
    order = np.argsort(-sizes, kind="stable").tolist()

    def settled(x: int) -> bool:
        return bool(done[x]) or size[root(largest)] > 1 and root(x) == root(largest)

    while todo := [x for x in order if not settled(x)]:
        for x in todo:
            if settled(x):
                continue
            done[x] = True
            mine = code[firsts[x] : firsts[x] + sizes[x]]
            mine = mine[np.argsort(counts[mine], kind="stable")]
            need = -(-75 * sizes[x] // 100)  # least shared shingles of a linked pair
            rare = mine[: sizes[x] - need + 1]
            near = np.unique(_gather(posting, begins[rare], counts[rare]))
            small, great = np.minimum(sizes[near], sizes[x]), np.maximum(sizes[near], sizes[x])
            near = near[(near != x) & (100 * small >= 75 * great)]
            if across:
                near = near[sides[near] != sides[x]]
            if not len(near):
                continue
            mark = np.zeros(len(distinct), bool)
            mark[mine] = True
            both = _shared(mark, code, firsts[near], sizes[near])
            for y in near[linked(sizes[x], sizes[near], both)].tolist():
                a, b = root(x), root(y)
                if a != b:
                    if size[a] < size[b]:
                        a, b = b, a
                    parent[b] = a
                    size[a] += size[b]
                    links.append((x, y))
                    if size[a] > size[root(largest)]:
                        largest = a
    return links


def _gather(values: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated slices of ``values``."""
    total = int(counts.sum())
    if not total:
        return values[:0]
    shift = np.repeat(begins - (np.cumsum(counts) - counts), counts)
    return values[np.arange(total) + shift]


def _shared(mark: np.ndarray, code: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many marked codes each slice holds, a bounded number of codes at a time."""
    out = np.empty(len(begins), np.int64)
    step = max(1, 4_000_000 // max(1, int(counts.max())))
    for i in range(0, len(begins), step):
        b, c = begins[i : i + step], counts[i : i + step]
        out[i : i + step] = np.add.reduceat(mark[_gather(code, b, c)].astype(np.int64), np.cumsum(c) - c)
    return out


def _compare(table: pa.Table) -> pa.Table:
    rows = dict.fromkeys(zip(*(table.column(c).to_pylist() for c in ("node", "shingles", "side"))))
    nodes = [node for node, _, _ in rows]
    sets = [np.frombuffer(s, np.uint64) for _, s, _ in rows]
    links = spanning_forest(sets, np.array([side for _, _, side in rows]))
    return pa.table(
        {"a": pa.array([nodes[x] for x, _ in links], pa.int64()), "b": pa.array([nodes[y] for _, y in links], pa.int64())}
    )


def grouped(
    docs: DataFrame, bands: int = BANDS, hashes: int = HASHES, words: int = WORDS, block: int = BLOCK_SHINGLES
) -> DataFrame:
    """doc_id, text_key, n_shingles, group, component_id and kept for every row of ``docs``.

    Rows of one ``group`` are near copies; it is null without an id or shingles.
    """
    own = saved(sketches(docs, bands, hashes, words), "sketches")
    members = own.where("doc_id is not null and print is not null")
    # a class is named by a number of its own, as several may have the same smallest doc_id
    classes = saved(
        members.groupBy("print").agg(
            F.min("doc_id").alias("rep"), F.min_by("text_key", "doc_id").alias("rep_text"),
            F.first("halves").alias("halves"), F.first("n_shingles").alias("n_shingles"),
        ).withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    clusters = components(candidate_links(classes, bands))
    roots = clusters.select("component").distinct()
    clusters = clusters.unionByName(roots.select(F.col("component").alias("node"), "component"))
    sized = clusters.join(classes.select("node", "rep", "rep_text", "n_shingles"), "node")
    totals = sized.groupBy("component").agg(F.ceil(F.sum("n_shingles") / block).alias("blocks"))
    # each class of a cluster, with its block and the block pairs it takes part in
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    placed = saved(
        sized.join(totals, "component").select(
            "node", "rep", "rep_text", F.col("component").alias("cluster"), "blocks", mine.alias("side")
        ),
        "clusters",
    )
    # the sets come from the texts again, so that they are never stored for all documents; a
    # bitmap keeps the texts of almost all other documents out of the shuffle
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), text_key().alias("rep_text"), "text")
    named = F.xxhash64("rep", "rep_text")
    sets = (
        maybe_among(texts, bitmap(placed, named), named)
        .join(placed, ["rep", "rep_text"])
        .select("cluster", "blocks", "side", "node", "text")
        .mapInArrow(_shingle_rows(words), "cluster long, blocks long, side long, node long, shingles binary")
    )
    # one row per class and pair of blocks
    pairs = sets.select(
        "cluster", "side", "node", "shingles",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"),
    ).select(
        "cluster", "side", "node", "shingles",
        F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"),
    )
    links = pairs.groupBy("cluster", "low", "high").applyInArrow(_compare, "a long, b long")
    found = components(links)
    found = saved(found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()), "found")
    least = found.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    final = classes.select("print", "node", "rep").join(found.join(least, "component"), "node", "left").select(
        "print", F.coalesce("component", "node").alias("group"), F.coalesce("least", "rep").alias("found")
    )
    component = F.coalesce("found", "doc_id")
    known = F.col("doc_id").isNotNull()
    return own.join(final, "print", "left").select(
        "doc_id", "text_key", "n_shingles", F.when(known, F.col("group")).alias("group"),
        F.when(known, component).alias("component_id"),
        F.when(known, F.col("doc_id") == component).otherwise(True).alias("kept"),
    )


def near_duplicates(
    docs: DataFrame, bands: int = BANDS, hashes: int = HASHES, words: int = WORDS, block: int = BLOCK_SHINGLES
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    return grouped(docs, bands, hashes, words, block).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM starts
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT shared.a, shared.b FROM shared JOIN sizes x ON x.doc_id = shared.a JOIN sizes y ON y.doc_id = shared.b
  WHERE 100 * k >= 75 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r
), least AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, component_id,
       d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
