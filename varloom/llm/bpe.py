"""BPE encoding and decoding through a minimal acyclic transducer (operator 3).

The frequent words of the corpus are counted over all documents and compiled
into one automaton that shares suffixes: equal remainders are one state, and the
numbers on a word's arcs add up to its entry in a table of ids. The automaton is
one file in the shared checkpoint folder, fetched once per executor and memory-mapped by
its workers. A batch walks all its distinct words through the arcs at once;
words outside the lexicon are merged exactly. The lexicon decides speed only.

Defined cases: a missing or empty text has no ids and decodes to the empty text;
special tokens inside a text are their ids; other columns are kept.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import saved, text_slices
from varloom.llm.word_bpe import default_path, load
from varloom.session import ensure_checkpoint_dir

#: Words the lexicon holds, and the longest of them in bytes.
LEXICON_WORDS = 250_000
LEXICON_BYTES = 48
_COUNTED = 200_000
_MERGED = 200_000
_KEPT = 200_000  # words whose ids and text a digesting task keeps
_ALL = 4_096  # above every level and part


def _counter(path: str):
    def run(batches):
        bpe, counts = load(path), Counter()

        def rows():
            words = [w for w in counts if len(w.encode()) <= LEXICON_BYTES]
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for _, texts in text_slices(batch, "text"):
                for text in texts:
                    counts.update(bpe.words(text))
                if len(counts) > _COUNTED:  # partial sums go on, memory stays bounded
                    yield rows()
                    counts.clear()
        yield rows()

    return run


def frequent_words(docs: DataFrame, path: str, limit: int = LEXICON_WORDS) -> list[str]:
    """At most ``limit`` of the most frequent words of all documents that occur more than once.

    A histogram of the counts names the lowest level that enters whole, a second
    one the part of the next level (words of about equal count, by hash) that
    fills the rest, so no task sends words that do not enter.
    """
    counted = docs.select("text").mapInArrow(_counter(path), "word string, n long")
    totals = counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    # a level is a 64th of a doubling: at most 4 032 levels, whatever the input
    leveled = totals.withColumns({"level": -F.floor(F.log2("n") * 64), "part": F.pmod(F.xxhash64("word"), F.lit(4_096))})
    leveled = saved(leveled, "words")

    def room(rows: DataFrame, column: str, free: int) -> tuple[int, int]:
        """The first value of ``column`` that does not enter whole, and the free places before it."""
        for value, n in rows.groupBy(column).count().orderBy(column).collect():
            if n > free:
                return value, free
            free -= n
        return _ALL, free

    level, free = room(leveled, "level", limit)
    part, _ = room(leveled.where(F.col("level") == level), "part", free)
    chosen = (F.col("level") < level) | ((F.col("level") == level) & (F.col("part") < part))
    return [r[0] for r in leveled.where(chosen).select("word").collect()]


class Transducer:
    """Minimal acyclic automaton over UTF-8 bytes; arc outputs add up to a word's number.

    ``keys`` holds state * 256 + byte of every arc in order, ``target`` the next
    state, ``output`` what the arc adds, ``final`` whether a state ends a word.
    """

    FIELDS = (("keys", np.int64), ("target", np.int32), ("output", np.int32), ("final", np.uint8),
              ("offsets", np.int64), ("ids", np.int32))

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, words: list[bytes], ids: list[np.ndarray]) -> Transducer:
        """``words`` must be sorted and distinct."""
        # a trie of the last word's path; a finished suffix is replaced by an equal state
        known: dict[tuple, int] = {}
        arcs: list[tuple] = []
        finals: list[bool] = []
        path = [[False, []]]  # [ends a word, [(byte, state)]] along the last word

        def freeze(keep: int) -> None:
            while len(path) > keep + 1:
                ends, out = path.pop()
                state = (ends, tuple(out))
                number = known.get(state)
                if number is None:
                    number = known[state] = len(arcs)
                    arcs.append(state[1])
                    finals.append(ends)
                parent = path[-1][1]
                parent[-1] = (parent[-1][0], number)

        last = b""
        for word in words:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            freeze(common)
            for byte in word[common:]:
                path[-1][1].append((byte, -1))
                path.append([False, []])
            path[-1][0] = True
            last = word
        freeze(0)
        root = len(arcs)
        arcs.append(tuple(path[0][1]))
        finals.append(path[0][0])
        below = [0] * len(arcs)  # words that end at or below a state; targets have smaller numbers
        keys, target, output = [], [], []
        for state, out in enumerate(arcs):
            total = int(finals[state])
            for byte, to in out:
                keys.append((root - state) << 8 | byte)
                target.append(root - to)
                output.append(total)
                total += below[to]
            below[state] = total
        order = np.argsort(np.array(keys, np.int64))
        sizes = [len(x) for x in ids]
        return cls({
            "keys": np.array(keys, np.int64)[order], "target": np.array(target, np.int32)[order],
            "output": np.array(output, np.int32)[order], "final": np.array(finals[::-1], np.uint8),
            "offsets": np.concatenate(([0], np.cumsum(sizes))).astype(np.int64),
            "ids": np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32),
        })

    def to_bytes(self) -> bytes:
        parts = [np.ascontiguousarray(getattr(self, name)) for name, _ in self.FIELDS]
        head = np.array([len(x) for x in parts], np.int64).tobytes()
        return head + b"".join(x.tobytes() + b"\0" * (-x.nbytes % 8) for x in parts)

    @classmethod
    def mapped(cls, file: str) -> Transducer:
        raw = np.asarray(np.memmap(file, np.uint8, "r"))  # a plain view: slices of it are cheaper
        sizes, at, arrays = raw[: 8 * len(cls.FIELDS)].view(np.int64), 8 * len(cls.FIELDS), {}
        for (name, kind), n in zip(cls.FIELDS, sizes.tolist()):
            width = n * np.dtype(kind).itemsize
            arrays[name] = raw[at : at + width].view(kind)
            at += width + -width % 8
        return cls(arrays)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, or -1; all words walk one byte per step."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        found = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not len(words):
            return found
        cells = np.frombuffer(b"".join(words), np.uint8)
        begins = np.cumsum(sizes) - sizes
        rows = np.flatnonzero((sizes > 0) & (sizes <= LEXICON_BYTES))
        state, total = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        step = 0
        while len(rows):
            key = state << 8 | cells[begins[rows] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            rows, arc, total = rows[ok], arc[ok], total[ok]
            state, total = self.target[arc].astype(np.int64), total + self.output[arc]
            step += 1
            over = sizes[rows] == step
            ended = over & (self.final[state] == 1)
            found[rows[ended]] = total[ended]
            rows, state, total = rows[~over], state[~over], total[~over]
        return found


def build_lexicon(docs: DataFrame, path: str, limit: int = LEXICON_WORDS) -> str:
    """Compile the frequent words, write the file to the shared folder, return its name."""
    bpe = load(path)
    words = sorted(frequent_words(docs, path, limit), key=str.encode)
    data = Transducer.build([w.encode() for w in words], bpe.encode_words(words)).to_bytes()
    spark = docs.sparkSession
    name = f"lexicon-{uuid.uuid4().hex}"
    place = f"{ensure_checkpoint_dir(spark)}/{name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(place)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop)
    out.write(data)
    out.close()
    spark.sparkContext.addFile(place)
    return name


_mapped: dict[str, Transducer] = {}


class Encoder:
    """Ids of texts; keeps the ids of unseen words between batches, up to a bound."""

    def __init__(self, lexicon: str, path: str):
        if lexicon not in _mapped:
            _mapped.clear()
            _mapped[lexicon] = Transducer.mapped(SparkFiles.get(lexicon))
        self.lexicon, self.bpe, self.merged = _mapped[lexicon], load(path), {}
        self.table, self.ends = self.lexicon.ids.tobytes(), (4 * self.lexicon.offsets).tolist()

    def word_ids(self, words: list[str]) -> list[np.ndarray]:
        """Ids of distinct words, from the lexicon or merged."""
        numbers = self.lexicon.numbers([w.encode() for w in words]).tolist()
        unseen = [w for w, k in zip(words, numbers) if k < 0]
        merged = iter(self.bpe.encode_words(unseen))
        offsets, ids = self.lexicon.offsets, self.lexicon.ids
        return [ids[offsets[k] : offsets[k + 1]] if k >= 0 else next(merged) for k in numbers]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.bpe.words(t) for t in texts]
        distinct = list({w for words in split for w in words})
        numbers = self.lexicon.numbers([w.encode() for w in distinct])
        unseen = [w for w, k in zip(distinct, numbers.tolist()) if k < 0 and w not in self.merged]
        if len(self.merged) > _MERGED:
            self.merged.clear()
            unseen = [w for w, k in zip(distinct, numbers.tolist()) if k < 0]
        self.merged.update(zip(unseen, (x.tobytes() for x in self.bpe.encode_words(unseen))))
        table, ends = self.table, self.ends
        of = {
            w: table[ends[k] : ends[k + 1]] if k >= 0 else self.merged[w] for w, k in zip(distinct, numbers.tolist())
        }
        return [np.frombuffer(b"".join(map(of.__getitem__, words)), np.int32) for words in split]


def _encode(lexicon: str, path: str, column: str):
    def run(batches):
        encoder = Encoder(lexicon, path)
        for batch in batches:
            for start, texts in text_slices(batch, column):
                encoded = encoder(texts)
                flat = np.concatenate(encoded)
                ends = np.concatenate(([0], np.cumsum([len(x) for x in encoded]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
                rest = [c for c in batch.schema.names if c != column]
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), ids], names=[*rest, "ids"])

    return run


def _ddl(df: DataFrame, without: str) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name != without)


def encode(docs: DataFrame, path: str | None = None, limit: int = LEXICON_WORDS, text: str = "text") -> DataFrame:
    """``docs`` with the text column replaced by ``ids``, an array of ints."""
    path = path or default_path()
    lexicon = build_lexicon(docs.select(F.col(f"`{text}`").alias("text")), path, limit)
    return docs.mapInArrow(_encode(lexicon, path, text), _ddl(docs, text) + "ids array<int>")


def _decode(path: str, column: str):
    def run(batches):
        bpe = load(path)
        for batch in batches:
            values = batch.column(column)
            rest = [c for c in batch.schema.names if c != column]
            for start in range(0, len(values), 64):
                part = batch.slice(start, 64)
                texts = [bpe.text(x or ()) for x in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in rest), pa.array(texts, pa.string())], names=[*rest, "decoded"]
                )

    return run


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``encoded`` with the ids replaced by ``decoded``, the token texts joined by spaces."""
    path = path or default_path()
    return encoded.mapInArrow(_decode(path, ids), _ddl(encoded, ids) + "decoded string")


def _digests(lexicon: str, path: str):
    """Ids and decoded text are made once per distinct word and kept, up to a bound."""

    def run(batches):
        encoder, known = Encoder(lexicon, path), {}
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for _, texts in text_slices(batch, "text"):
                split = [encoder.bpe.words(t) for t in texts]
                fresh = set().union(*split).difference(known)
                if len(known) + len(fresh) > _KEPT:
                    known.clear()
                    fresh = set().union(*split)
                fresh = list(fresh)
                for word, ids in zip(fresh, encoder.word_ids(fresh)):
                    ids = ids.tolist()
                    known[word] = " ".join(map(str, ids)).encode(), encoder.bpe.text(ids).encode()
                for words in split:
                    ids, decoded = map(b" ".join, zip(*map(known.__getitem__, words))) if words else (b"", b"")
                    counts.append(ids.count(b" ") + 1 if words else 0)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text.

    Encodes and decodes in one pass: neither ids nor decoded texts leave the task.
    """
    path = path or default_path()
    lexicon = build_lexicon(docs.select("text"), path)
    return docs.select("doc_id", "text").mapInArrow(
        _digests(lexicon, path),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
