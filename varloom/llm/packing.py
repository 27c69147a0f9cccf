"""Packing of token sequences by first-fit decreasing (operator 6).

A document's ids are cut at multiples of the sequence length; whole cuts fill a
sequence alone. All pieces are dealt into random groups of bounded expected
size, and each group is packed on its own: pieces from long to short go into the
first open sequence with room, found in a tournament tree of free capacities.
No ids are moved: a piece carries its length and checksum.

Defined cases: a missing or empty text is the end token alone; repeated rows are
separate documents; a missing ``doc_id`` stays missing; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import saved, text_slices
from varloom.llm.word_bpe import default_path, load

LENGTH = 4096
END_ID = 2
#: Pieces a group holds on average.
GROUP_PIECES = 4_000
_KEPT = 500_000


def _pieces(path: str, length: int):
    def run(batches):
        bpe, kept = load(path), {}
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for first, texts in text_slices(batch, "text"):
                split = [bpe.words(t) for t in texts]
                unseen = list({w for words in split for w in words if w not in kept})
                if len(kept) + len(unseen) > _KEPT:
                    kept.clear()
                    unseen = list({w for words in split for w in words})
                kept.update(zip(unseen, (x.astype("<u4").tobytes() for x in bpe.encode_words(unseen))))
                row, start, size, crc, total = [], [], [], [], []
                for k, words in enumerate(split):
                    data = b"".join(map(kept.__getitem__, words)) + end
                    n = len(data) // 4
                    for at in range(0, n, length):
                        row.append(first + k)
                        start.append(at)
                        size.append(min(length, n - at))
                        crc.append(zlib.crc32(data[4 * at : 4 * (at + length)]))
                        total.append(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row, pa.int64())),
                     *(pa.array(x, pa.int64()) for x in (start, size, crc, total))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return run


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _pieces(path or default_path(), length),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long",
    )


def first_fit(sizes: np.ndarray, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size, taken in the order given.

    The tournament tree keeps in every node the largest free capacity below it,
    so the first bin with room is found by one walk down.
    """
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for size in sizes.tolist():
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bins.append(node - leaves)
        offsets.append(capacity - free[node])
        free[node] -= size
        while node > 1:
            node //= 2
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
    return bins, offsets


def _packer(length: int):
    def run(table: pa.Table) -> pa.Table:
        # a fixed order, so that a repeated task packs alike
        order = [("length", "descending"), *((c, "ascending") for c in ("doc_id", "start", "ids_crc32", "row"))]
        table = table.sort_by(order)
        bins, offsets = first_fit(table.column("length").to_numpy(), length)
        group = table.column("group").to_numpy()
        return table.drop_columns(["group", "row"]).append_column(
            "sequence_id", pa.array((group << 32) + np.array(bins, np.int64), pa.int64())
        ).append_column("offset", pa.array(offsets, pa.int64()))

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; every sequence holds at most ``length`` ids."""
    rows = saved(pieces(docs, path, length), "pieces").withColumn("row", F.monotonically_increasing_id())
    groups = max(1, -(-rows.count() // group_pieces))
    dealt = saved(
        rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "row"), F.lit(groups))), "dealt"
    )
    return dealt.groupBy("group").applyInArrow(
        _packer(length),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
