"""Phrase collocations by set-oriented mining, SETM (operator 13).

Occurrences are a relation (piece, position, word), written once as a table
bucketed by piece and sorted by piece and position. The occurrences of ``k``
words are a merge join of those of ``k - 1`` words with that table, on the piece
and the next position; buckets meet buckets, so no row is shuffled for it. They
are counted by group, and a semi-join with the frequent groups is persisted in
the same form before the next length.

* Words travel as longs. The most frequent words (a bounded number) have dense
  ids, which tasks look up; any other word is named by a 64-bit hash. The words
  are checked for equal hashes, and hashed anew in that case, so names are exact.
* The semi-join meets a bitmap of the frequent groups of fixed size. A group
  that passes by chance is not frequent, nor is any phrase that begins with it,
  so the next count drops it: the result does not depend on the bitmap's size.
* A piece of more than ``SEGMENT`` words is cut; a segment repeats the first
  words of the next one, which continue phrases but begin none.

Defined cases: a missing text has no words; a missing lang is ``und``; rows that
share a ``doc_id`` or have none are texts like others; an empty table gives no
rows; other columns are ignored. Counts are exact below 10^16.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.common import bitmap, maybe_among, saved
from varloom.session import ensure_checkpoint_dir

MOST_WORDS, LEAST_COUNT, KEPT_PERCENT, FIRST = 3, 10, 50, 2_000
BREAKS, BLANKS = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
#: Words with dense ids at most, and the longest of them.
DENSE, DENSE_CHARS = 1 << 18, 64
#: Words of a piece that one segment begins phrases at.
SEGMENT = 1_024
#: Bits of a bitmap of frequent groups, and words of the text a bucket holds about.
BITS, BUCKET_WORDS = 1 << 25, 4_000_000
#: Texts and characters cut at once, and words counted at once.
ROWS, CHARS, HELD_WORDS = 128, 1 << 20, 2_000_000


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all pieces of the texts one after the other, and how many each piece has."""
    pieces = pc.split_pattern_regex(pc.ascii_lower(texts), BREAKS).flatten()
    lists = pc.split_pattern_regex(pieces, BLANKS)
    words, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    filled = pc.not_equal(pc.binary_length(words), 0)
    held = np.concatenate(([0], np.cumsum(filled.to_numpy(zero_copy_only=False))))
    return words.filter(filled), np.diff(held[ends.astype(np.int64)], prepend=0)


def _by_language(batch: pa.RecordBatch):
    """(language, texts) of a batch, a bounded amount of text at a time."""
    langs = batch.column("lang").dictionary_encode()
    of = langs.indices.to_numpy(zero_copy_only=False)
    for code, lang in enumerate(langs.dictionary.to_pylist()):
        texts = batch.column("text").filter(pa.array(of == code))
        sizes = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(texts):
            done = sizes[start - 1] if start else 0
            end = max(start + 1, min(start + ROWS, int(np.searchsorted(sizes, done + CHARS))))
            yield lang, texts.slice(start, end - start)
            start = end


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )


def _counted(batches):
    """Words and their counts, combined over a bounded number of words."""

    def rows(lang, words):
        found = pc.value_counts(pa.chunked_array(words, pa.string()))
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(found), pa.string()), found.field("values"), found.field("counts")],
            names=["lang", "word", "n"],
        )

    seen: dict[str, list] = {}
    held = 0
    for batch in batches:
        for lang, texts in _by_language(batch):
            words = split_words(texts)[0]
            seen.setdefault(lang, []).append(words)
            held += len(words)
            if held > HELD_WORDS:
                yield from (rows(*one) for one in seen.items())
                seen, held = {}, 0
    yield from (rows(*one) for one in seen.items())


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word and f, how often it occurs."""
    some = _texts(docs).mapInArrow(_counted, "lang string, word string, n long")
    return some.groupBy("lang", "word").agg(F.sum("n").alias("f"))


def _hash_id(salt: int) -> Column:
    """A negative long for a word of a language."""
    return F.xxhash64(F.lit(str(salt)), "lang", "word").bitwiseOR(F.lit(-(2**63)))


def hash_id(salt: int, lang: str, word: str) -> int:
    """As :func:`_hash_id`, within a task."""
    seed = 42
    for part in (str(salt), lang, word):
        seed = xxhash.xxh64_intdigest(part.encode("utf-8", "surrogatepass"), seed)
    return (seed | 1 << 63) - (1 << 64)


def _named(counts: DataFrame, least: int, dense: int) -> tuple[DataFrame, pa.Table, int]:
    """(id, lang, word, f) of the frequent words, the words with dense ids in order, the salt of the others."""
    level = F.floor(F.log2("f") * 8).cast("int")
    short = (F.char_length("word") <= DENSE_CHARS) & (F.col("f") >= least)
    held = counts.where(short).groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # one row an eighth of a power of two
    total, lowest = 0, 1 << 30
    for r in held:
        total += r["count"]
        if total > dense:
            break
        lowest = r["level"]
    top = short & (level >= lowest)
    known = counts.where(top).select("lang", "word", "f").toArrow().sort_by([("f", "descending"), ("lang", "ascending"), ("word", "ascending")])
    ids = known.append_column("id", pa.array(np.arange(len(known), dtype=np.int64)))
    rest = counts.where(~top)
    salt = 0
    while not rest.groupBy(_hash_id(salt).alias("id")).count().where("count > 1").isEmpty():
        salt += 1
    schema = "lang string, word string, f long, id long"
    first = counts.sparkSession.createDataFrame(ids.select(["lang", "word", "f", "id"]).to_pandas(), schema)
    others = rest.where(F.col("f") >= least).select("lang", "word", "f", _hash_id(salt).alias("id"))
    return saved(first.unionByName(others), "frequent-words"), ids, salt


def _segments(dense: dict, salt: int, frequent: np.ndarray, ahead: int):
    """Pieces as arrays of word ids; null stands for a word that is not frequent."""
    mask = np.uint64(BITS - 1)

    def ids_of(lang: str, words: pa.Array) -> np.ndarray:
        """Ids; 2^62 where the word is not frequent."""
        names = dense.get(lang)
        out = np.full(len(words), 2**62, np.int64)
        known = pc.index_in(words, names[0]).to_numpy(zero_copy_only=False) if names else np.full(len(words), np.nan)
        found = ~np.isnan(known)
        if names:
            out[found] = names[1][known[found].astype(np.int64)]
        if not found.all():
            other = words.filter(pa.array(~found)).dictionary_encode()
            hashed = np.array([hash_id(salt, lang, w) for w in other.dictionary.to_pylist()], np.int64)
            at = hashed.view(np.uint64) & mask
            held = (frequent[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
            hashed[held == 0] = 2**62
            out[~found] = hashed[other.indices.to_numpy(zero_copy_only=False)]
        return out

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lang, texts in _by_language(batch):
                words, lengths = split_words(texts)
                ids = ids_of(lang, words)
                begins = np.cumsum(lengths) - lengths
                begins, lengths = begins[lengths > 1], lengths[lengths > 1]
                if lengths.size and lengths.max() > SEGMENT:
                    parts = -(-lengths // SEGMENT)
                    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                    ends = np.repeat(begins + lengths, parts)
                    begins = np.repeat(begins, parts) + nth * SEGMENT
                    lengths = np.minimum(ends - begins, SEGMENT + ahead)
                offsets = np.concatenate(([0], np.cumsum(lengths)))
                take = np.arange(offsets[-1]) + np.repeat(begins - offsets[:-1], lengths)
                values = pa.array(ids[take], pa.int64(), mask=ids[take] == 2**62)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number + np.arange(len(lengths))), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)],
                    names=["piece", "words"],
                )
                number += len(lengths)

    return run


def _persist(rows: DataFrame, buckets: int) -> tuple[DataFrame, str, str]:
    """A table bucketed by piece and sorted by piece and position, in the shared folder."""
    spark = rows.sparkSession
    table = f"occurrences_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/{table}"
    rows.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, "piece").sortBy(
        "piece", "pos"
    ).saveAsTable(table)
    return spark.table(table), table, path


def _discard(rows: DataFrame, table: str, path: str) -> None:
    spark = rows.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Tables bucketed by one key of a join are joined as they lie, and a bucket's one file keeps its order.
BY_BUCKET = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
}
#: Few texts at once on their way to a task's Python.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextmanager
def settings(spark, wanted: dict[str, str]):
    """Session settings for the jobs started inside."""
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def frequent_phrases(docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST_COUNT, dense: int = DENSE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The word counts, the frequent words (id, lang, word, f), and the frequent phrases (phrase: ids, f) of all lengths."""
    spark = docs.sparkSession
    with settings(spark, SMALL_BATCHES):
        counts = saved(word_counts(docs), "word-counts")
    words, known, salt = _named(counts, least, dense)
    names: dict[str, tuple[pa.Array, np.ndarray]] = {}
    langs = known.column("lang").combine_chunks().dictionary_encode() if len(known) else None
    for code, lang in enumerate(langs.dictionary.to_pylist() if langs else []):
        mine = known.filter(pc.equal(langs.indices, code))
        names[lang] = (mine.column("word").combine_chunks(), mine.column("id").to_numpy())
    frequent = np.zeros(BITS // 64, np.uint64)
    for batch in bitmap(words.where("id < 0"), F.col("id"), BITS).toArrow().to_batches():
        frequent[batch.column("slot").to_numpy()] = batch.column("held").to_numpy().view(np.uint64)
    total = counts.agg(F.sum("f")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_WORDS))

    pieces = _texts(docs).mapInArrow(_segments(names, salt, frequent, most - 1), "piece long, words array<long>")
    occurrences = (
        pieces.repartition(buckets, "piece").select("piece", F.posexplode("words").alias("pos", "w1")).where("w1 is not null")
    )
    with settings(spark, SMALL_BATCHES):
        held = [_persist(occurrences, buckets)]
    single = held[0][0]
    rows, found = single.where(F.col("pos") < SEGMENT), words.select(F.array("id").alias("phrase"), "f")
    with settings(spark, BY_BUCKET):
        for k in range(2, most + 1):
            mine = [f"w{i}" for i in range(1, k + 1)]
            after = single.select(F.col("piece").alias("_piece"), F.col("pos").alias("_pos"), F.col("w1").alias(mine[-1]))
            joined = rows.hint("merge").join(
                after, (F.col("piece") == F.col("_piece")) & (F.col("pos") + (k - 1) == F.col("_pos"))
            ).select("piece", "pos", *mine)
            groups = saved(joined.groupBy(*mine).agg(F.count(F.lit(1)).alias("f")).where(F.col("f") >= least), f"phrases-{k}")
            found = found.unionByName(groups.select(F.array(*mine).alias("phrase"), "f"))
            if k < most:
                bits = bitmap(groups, F.xxhash64(*mine), BITS)
                held.append(_persist(maybe_among(joined, bits, F.xxhash64(*mine), BITS), buckets))
                rows = held[-1][0]
    for table in held:
        _discard(*table)
    return counts, words, found


def scored(found: DataFrame, percent: int = KEPT_PERCENT) -> DataFrame:
    """phrase, a, l, r and score of the phrases that no longer one covers."""
    size = F.size("phrase")
    candidates = found.where(size > 1).select("phrase", F.col("f").alias("a"))
    cut = candidates.select("phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.select("phrase", "a", "k", F.slice("phrase", 1, F.col("k")).alias("first"), F.slice("phrase", F.col("k") + 1, size).alias("rest"))
    part = lambda name, f: found.select(F.col("phrase").alias(name), F.col("f").alias(f))
    cut = cut.join(part("first", "l"), "first").join(part("rest", "r"), "rest")
    wide = lambda c: f"cast({c} as decimal(20,0))"
    score = F.expr(f"({wide('a')} * {wide('a')} * cast(1000000 as decimal(7,0))) div ({wide('l')} * {wide('r')})")
    best = cut.groupBy("phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("least"))
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda s: F.slice("phrase", s, n)),
        )
    )
    longer = candidates.where(size > 2).select(F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    covered = longer.groupBy("phrase").agg(F.max("longer").alias("longer"))
    free = best.join(covered, "phrase", "left").where(
        F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(percent) * F.col("a"))
    )
    return free.select("phrase", "a", "least.l", "least.r", "least.score")


def collocations(
    docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST_COUNT, percent: int = KEPT_PERCENT, first: int = FIRST, dense: int = DENSE
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``first`` collocations of each language."""
    counts, words, found = frequent_phrases(docs, most, least, dense)
    good = saved(scored(saved(found, "phrases"), percent), "collocations")
    spelt = good.select("phrase", F.posexplode("phrase").alias("pos", "id")).join(words.select("id", "lang", "word"), "id")
    spelt = spelt.groupBy("phrase").agg(
        F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("spelt")
    )
    named = good.join(spelt, "phrase").select(
        "lang", F.array_join(F.col("spelt.word"), " ").alias("phrase"), "a", "l", "r", "score"
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
    n = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i
  FROM (SELECT lang, w, unnest([1, 2, 3]) AS k FROM words) WHERE len(w) >= k
), freq AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM grams GROUP BY ALL
), candidates AS MATERIALIZED (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM freq WHERE k > 1 AND f >= 10
), halves AS (
  SELECT lang, k AS size, phrase, a, j, array_to_string(w[1:j], ' ') AS first, array_to_string(w[j + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates)
), cuts AS (
  SELECT h.*, l.f AS l, r.f AS r,
         CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM halves h JOIN freq l ON l.lang = h.lang AND l.k = j AND l.phrase = first
  JOIN freq r ON r.lang = h.lang AND r.k = size - j AND r.phrase = rest
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, size, phrase ORDER BY score, j) = 1
), longer AS (
  SELECT lang, array_to_string(w[s:s + 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest([1, 2]) AS s FROM candidates WHERE k = 3) GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN longer USING (lang, phrase) JOIN n USING (lang)
WHERE NOT coalesce(size = 2 AND 100 * longer >= 50 * a, false)
QUALIFY rank <= 2000
"""
