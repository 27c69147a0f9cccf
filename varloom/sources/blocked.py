"""Block-compressed text (BGZF): one large file spreads over tasks.

The format is a chain of small gzip members that state their own length, so a reader
may start at any of them. A file is cut at fixed byte offsets; a task finds the first
block at or behind its offset and inflates blocks up to the next one. A line belongs
to the task in whose blocks it begins: every task but a file's first leaves out the
bytes up to the first line end, and every task reads on to the end of its last line.
"""

from __future__ import annotations

import struct
import zlib
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.sources.streams import open_output, open_stream

#: Compressed bytes of one task, bytes a block can have at most, and plain bytes a written block holds.
SPLIT_BYTES, BLOCK_BYTES, PLAIN_BYTES = 32 << 20, 1 << 16, 0xFF00
MAGIC = b"\x1f\x8b\x08\x04"
_LINES = 8_192
#: Splits of a scan at most, by core.
CORE_SPLITS = 64
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block_size(head: bytes, at: int = 0) -> int | None:
    """Length of the block that begins at ``at``; None where none begins."""
    if head[at : at + 4] != MAGIC or len(head) < at + 12:
        return None
    (extra,) = struct.unpack_from("<H", head, at + 10)
    field, end = at + 12, at + 12 + extra
    while field + 4 <= min(end, len(head)):
        name, (size,) = head[field : field + 2], struct.unpack_from("<H", head, field + 2)
        if name == b"BC" and size == 2 and field + 6 <= len(head):
            return struct.unpack_from("<H", head, field + 4)[0] + 1
        field += 4 + size
    return None


def first_block(stream, start: int, length: int) -> int:
    """Offset of the first block at or behind ``start``; ``length`` if there is none.

    Bytes inside a block may look like a head, so the block after it must begin with one too.
    """
    if not start:
        return 0
    stream.seek(start)
    window = stream.read(3 * BLOCK_BYTES)
    at = window.find(MAGIC)
    while at >= 0:
        size = block_size(window, at)
        if size:
            after = at + size
            if start + after == length or block_size(window, after):
                return start + at
        at = window.find(MAGIC, at + 1)
    return length


def inflate(block: bytes) -> bytes:
    (extra,) = struct.unpack_from("<H", block, 10)
    plain = zlib.decompress(block[12 + extra : -8], -15)
    check, size = struct.unpack("<II", block[-8:])
    if size != len(plain) or zlib.crc32(plain) != check:
        raise ValueError("damaged block")
    return plain


def split_lines(stream, start: int, end: int, length: int):
    """Lines that begin in the blocks of one split, without their line ends."""
    at = first_block(stream, start, length)
    if at >= min(end, length):
        return
    skip, rest = start > 0, b""
    while at < length:
        over = at >= end
        stream.seek(at)
        head = stream.read(BLOCK_BYTES + 18)
        size = block_size(head)
        if size is None:
            raise ValueError("not block-compressed")
        at += size
        data = rest + inflate(head[:size])
        if skip:  # the end of a line of the split before
            _, found, data = data.partition(b"\n")
            if not found:
                rest = b""
                if over:
                    return
                continue
            skip = False
        if over:  # the last line goes on behind the split, and one that begins at its end belongs here
            line, found, _ = data.partition(b"\n")
            if found:
                yield line
                return
            rest = data
            continue
        *lines, rest = data.split(b"\n")
        yield from lines
    if rest and not skip:
        yield rest


def _read(batches):
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("path", "start", "end", "length"))
        for path, start, end, length in zip(*columns):
            with open_stream(path) as stream:
                held: list[str] = []
                for line in split_lines(stream, start, end, length):
                    held.append(line.decode("utf-8"))
                    if len(held) == _LINES:
                        yield _rows(path, start, held)
                        held = []
                if held:
                    yield _rows(path, start, held)


def _rows(path: str, start: int, lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(lines)), pa.array([start] * len(lines), pa.int64()), pa.array(lines, pa.string())],
        names=["path", "block_start", "value"],
    )


def split_table(spark: SparkSession, paths: str | list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, start, end, length) of the splits of all files; only the listing is read.

    Splits grow beyond ``split_bytes`` when there would be more than ``CORE_SPLITS`` per core:
    the driver keeps state for every task of every job.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(paths)
    total = listed.agg(F.coalesce(F.sum("length"), F.lit(0))).scalar()
    step = F.greatest(F.lit(split_bytes).cast("long"), F.ceil(total / F.lit(CORE_SPLITS * spark.sparkContext.defaultParallelism)))
    starts = listed.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step)).alias("start"))
    return starts.select("path", "start", (F.col("start") + step).alias("end"), "length")


def read_blocks(spark: SparkSession, paths: str | list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, block_start, value): the lines of block-compressed files, a task per split."""
    splits = split_table(spark, paths, split_bytes)
    tasks = max(1, splits.count())
    return splits.repartition(tasks, "path", "start").sortWithinPartitions("path", "start").mapInArrow(
        _read, "path string, block_start long, value string"
    )


def compress(lines) -> "list[bytes]":
    """Blocks of the given lines (bytes without line ends)."""
    held, size = [], 0
    for line in lines:
        held.append(line + b"\n")
        size += len(line) + 1
        if size >= PLAIN_BYTES:
            data = b"".join(held)
            whole = len(data) - len(data) % PLAIN_BYTES
            for at in range(0, whole, PLAIN_BYTES):
                yield _block(data[at : at + PLAIN_BYTES])
            held, size = [data[whole:]], len(data) - whole
    if size:
        yield _block(b"".join(held))


def _block(plain: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(plain) + packer.flush()
    if len(body) + 26 > BLOCK_BYTES:  # data that does not shrink is stored
        packer = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = packer.compress(plain) + packer.flush()
    head = MAGIC + b"\0" * 4 + b"\0\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(plain), len(plain))


def _pack(batches):
    """Blocks of the runs of lines of one path, named by the number of the run's first line."""
    rows = ((p, n, v) for b in batches for p, n, v in zip(*(b.column(c).to_pylist() for c in ("path", "line_no", "value"))))
    for path, run in groupby(rows, lambda r: r[0]):
        first = next(run)
        blocks = compress(r[2].encode("utf-8") for r in chain([first], run))
        for number, block in enumerate(blocks):
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([first[1]], pa.int64()), pa.array([number], pa.int64()), pa.array([block], pa.binary())],
                names=["path", "first", "number", "block"],
            )


def _write(directory: str):
    def run(batches):
        rows = ((p, x) for b in batches for p, x in zip(b.column("path").to_pylist(), b.column("block")))
        done = []
        for name, blocks in groupby(rows, lambda r: r[0]):
            with open_output(f"{directory}/{name}.gz") as out:
                for _, block in blocks:
                    out.write(block.as_py())
                out.write(END_BLOCK)
            done.append(f"{name}.gz")
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["file"])

    return run


def write_blocks(lines: DataFrame, directory: str) -> list[str]:
    """Write (path, line_no, value) as one block-compressed file per path, in order; the names written.

    Ranges of lines are compressed by all tasks; a file's own task only joins its blocks.
    """
    placed = lines.select("path", "line_no", "value").repartitionByRange("path", "line_no").sortWithinPartitions("path", "line_no")
    blocks = placed.mapInArrow(_pack, "path string, first long, number long, block binary")
    ordered = blocks.repartition("path").sortWithinPartitions("path", "first", "number")
    return [r["file"] for r in ordered.select("path", "block").mapInArrow(_write(directory), "file string").collect()]
