"""Line deduplication across documents (operator 1).

Hashes of normalised lines are range-partitioned and sorted by (hash, document,
position). A stream over each slice sees a line's first document first and
marks the lines of all later documents. Rows of one hash may span slices, so a
hot line spreads; the slices' boundary hashes settle who came first. The result
is a compressed keep bitmap per document; texts are not moved for it.

Defined cases: a missing or empty text is one empty line; a missing ``doc_id``
counts as one document after all others; rows that share a ``doc_id`` are one
document, told apart by a hash of their text, and equal rows share a bitmap;
other columns are ignored by the bitmaps and kept by :func:`drop_lines`.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import id_or_max, saved, text_slices

MIN_CHARS = 10
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DROP, PENDING, BOUNDARY = 0, 1, 2
_MARKS = "kind int, h1 long, h2 long, doc long, version long, pos int, n_lines int"


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(id_or_max().alias("doc"), F.xxhash64(text).alias("version"), text.alias("body"))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line that may be dropped: 128-bit hash of its key, document, position."""
    lines = (
        _identified(docs)
        .withColumn("lines", F.split("body", "\n"))
        .select("doc", "version", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    )
    key = F.translate(F.btrim("line", F.lit(SPACES)), UPPER, LOWER)
    return (
        lines.withColumn("line", key)
        .where(F.char_length("line") >= min_chars)
        .select(
            F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"),
            "doc", "version", "pos", "n_lines",
        )
    )


def _mark(batches):
    """Stream one slice in (hash, document, position) order; keeps one key and its owner."""
    key = owner = first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, version, pos, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = key != (h1[0], h2[0])
        starts = np.maximum.accumulate(np.where(new, np.arange(len(h1)), -1))
        owners = np.where(starts >= 0, doc[np.maximum(starts, 0)], owner if owner is not None else 0)
        if first is None:
            first = (h1[0], h2[0])
            yield _rows(BOUNDARY, h1[:1], h2[:1], owners[:1], version[:1], pos[:1], n[:1])
        in_first = (h1 == first[0]) & (h2 == first[1])
        late = doc != owners
        for kind, take in ((DROP, late), (PENDING, in_first & ~late)):
            if take.any():
                yield _rows(kind, h1[take], h2[take], doc[take], version[take], pos[take], n[take])
        key, owner = (h1[-1], h2[-1]), owners[-1]
    if key is not None:
        one = np.zeros(1, np.int64)
        yield _rows(BOUNDARY, np.array([key[0]]), np.array([key[1]]), np.array([owner]), one, one, one)


def _rows(kind, h1, h2, doc, version, pos, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(h1), kind, np.int32)), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
            pa.array(doc, pa.int64()), pa.array(version, pa.int64()),
            pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32)),
        ],
        names=["kind", "h1", "h2", "doc", "version", "pos", "n_lines"],
    )


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, version, pos, n_lines) of every line that goes."""
    order = ["h1", "h2", "doc", "version", "pos"]
    placed = line_hashes(docs, min_chars).repartitionByRange(*order).sortWithinPartitions(*order)
    marks = saved(placed.mapInArrow(_mark, _MARKS), "line-marks")
    owners = (
        marks.where(F.col("kind") == BOUNDARY).groupBy("h1", "h2").agg(F.min("doc").alias("owner"))
    )
    late = marks.where(F.col("kind") == PENDING).join(owners, ["h1", "h2"]).where("doc <> owner")
    columns = ["doc", "version", "pos", "n_lines"]
    return marks.where(F.col("kind") == DROP).select(*columns).unionByName(late.select(*columns))


def pack_bits(n_lines: int, dropped) -> bytes:
    """Compressed bitmap with one bit per line, set where the line stays."""
    keep = np.ones(n_lines, bool)
    keep[np.asarray(dropped, np.int64)] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack_bits(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def _to_bitmaps(batches):
    for batch in batches:
        n, dropped = batch.column("n_lines").to_pylist(), batch.column("dropped").to_pylist()
        distinct = [sorted(set(d)) for d in dropped]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc"), batch.column("version"), batch.column("n_lines"),
                pa.array([len(d) for d in distinct], pa.int32()),
                pa.array([pack_bits(k, d) for k, d in zip(n, distinct)], pa.binary()),
            ],
            names=["doc", "version", "n_lines", "n_dropped", "keep_bitmap"],
        )


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Keep bitmap of every document that loses a line; the others keep all lines.

    Columns: doc (id, or the largest long where it is missing), version (hash
    of the text), n_lines, n_dropped, keep_bitmap.
    """
    grouped = (
        dropped_lines(docs, min_chars)
        .groupBy("doc", "version")
        .agg(F.first("n_lines").alias("n_lines"), F.collect_list("pos").alias("dropped"))
    )
    return grouped.mapInArrow(
        _to_bitmaps, "doc long, version long, n_lines int, n_dropped int, keep_bitmap binary"
    )


def _apply(batches):
    for batch in batches:
        maps, kept, lines, gone = batch.column("keep_bitmap"), [], [], []
        for start, texts in text_slices(batch, "_body"):
            for text, bitmap in zip(texts, maps.slice(start, len(texts)).to_pylist()):
                parts = text.split("\n")
                lines.append(len(parts))
                if bitmap is None:
                    kept.append(text)
                    gone.append(0)
                    continue
                stays = unpack_bits(bitmap, len(parts))
                kept.append("\n".join(parts[i] for i in np.flatnonzero(stays)))
                gone.append(int(len(parts) - stays.sum()))
        rest = [c for c in batch.schema.names if c not in ("_body", "keep_bitmap")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in rest), pa.array(kept, pa.string()), pa.array(lines, pa.int64()),
             pa.array(gone, pa.int64())],
            names=[*rest, "_kept", "_n_lines", "_n_dropped"],
        )


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every row of ``docs`` with ``_kept`` (its text without repeated lines), ``_n_lines``, ``_n_dropped``."""
    bitmaps = keep_bitmaps(docs, min_chars).select(
        F.col("doc").alias("_doc"), F.col("version").alias("_version"), "keep_bitmap"
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != "text"],
        id_or_max().alias("_doc"), F.xxhash64(text).alias("_version"), text.alias("_body"),
    )
    joined = own.join(bitmaps, ["_doc", "_version"], "left").drop("_doc", "_version")
    rest = joined.drop("_body", "keep_bitmap").schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return joined.mapInArrow(_apply, f"{schema}, _kept string, _n_lines long, _n_dropped long")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text."""
    return drop_lines(docs.select("doc_id", "text")).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), owners AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT d.*, o.owner IS NOT NULL AND o.owner <> d.doc_id AS gone
  FROM keyed d LEFT JOIN owners o USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
