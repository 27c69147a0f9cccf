"""Toxicity by a factorization machine over hashed terms (operator 7).

A document is the set of its hashed words and word beginnings. The terms that
differ most between the classes get a weight and a small vector each; the score
adds the weights and the products of all pairs of vectors, so that two terms
together can weigh more, or less, than each alone. Training uses a bounded
sample of labelled documents that are not held out; scoring reads whole texts.

Defined cases: missing and empty texts score by the bias alone; without any
label the score is 0; a class that no label has gives the share of the other;
rows that share an id are scored one by one; other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import saved, text_slices
from varloom.llm.labelled import held_out, training_sample

#: Labelled documents that training reads at most.
SAMPLE_ROWS = 20_000
BUCKET_BITS = 22
#: Terms with a weight, documents a term must be in, and squared z value it must reach.
TERMS, LEAST_DOCS, LEAST_Z2 = 4_096, 4, 12.0
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 15, 256, 0.1, 1e-4
PREFIX = 4
_KEPT = 120_000
_STRIP = " \t.,;:!?\"'()[]{}<>|*#%&$+-=_/\\~`^@0123456789«»“”„‘’…–—¿¡"


def term_hashes(chunk: str) -> tuple[int, ...]:
    """Buckets of a lower-case word without its outer signs, and of its beginning."""
    word = chunk.strip(_STRIP)
    if not word:
        return ()
    shift = 64 - BUCKET_BITS
    whole = xxhash.xxh3_64_intdigest(b"w" + word.encode("utf-8", "surrogatepass")) >> shift
    if len(word) <= PREFIX:
        return (whole,)
    return whole, xxhash.xxh3_64_intdigest(b"p" + word[:PREFIX].encode("utf-8", "surrogatepass")) >> shift


class Terms:
    """Distinct term numbers of a text; ``number`` maps a bucket to a number or None."""

    def __init__(self, number=None):
        self.number, self.kept = number, {}

    def _of(self, chunk: str) -> tuple[int, ...]:
        if len(self.kept) >= _KEPT:
            self.kept.clear()
        found = term_hashes(chunk)
        if self.number is not None:
            found = tuple(n for h in found if (n := self.number.get(h)) is not None)
        self.kept[chunk] = found
        return found

    def __call__(self, text: str) -> set[int]:
        out, kept = set(), self.kept
        for chunk in set(text.lower().split()):
            found = kept.get(chunk)
            if found is None:
                found = self._of(chunk)
            if found:
                out.update(found)
        return out


def _term_rows(batches):
    terms = Terms()
    for batch in batches:
        labels = batch.column("label")
        for start, texts in text_slices(batch, "text"):
            found = [sorted(terms(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [labels.slice(start, len(texts)), pa.array(found, pa.list_(pa.int32()))], names=["label", "terms"]
            )


class Machine:
    """Bias, weights and vectors; the terms it knows in order of their number."""

    def __init__(self, buckets: list[int], bias: float):
        self.buckets, self.bias = buckets, bias
        self.weights = np.zeros(len(buckets))
        self.vectors = np.random.default_rng(5).normal(0, 0.05, (len(buckets), FACTORS))

    def margins(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(sizes)), sizes)
        linear = np.bincount(row, self.weights[flat], len(sizes))
        sums, squares = np.zeros((len(sizes), FACTORS)), np.zeros(len(sizes))
        np.add.at(sums, row, self.vectors[flat])
        np.add.at(squares, row, (self.vectors[flat] ** 2).sum(1))
        return self.bias + linear + 0.5 * ((sums**2).sum(1) - squares)

    def fit(self, rows: list[np.ndarray], labels: np.ndarray) -> None:
        """Logistic loss, adaptive gradient steps over shuffled batches."""
        rng = np.random.default_rng(7)
        sizes = np.array([len(r) for r in rows])
        g_bias, g_w, g_v = 1e-6, np.full(len(self.weights), 1e-6), np.full(self.vectors.shape, 1e-6)
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), BATCH):
                pick = order[at : at + BATCH]
                n, flat = sizes[pick], np.concatenate([rows[k] for k in pick])
                error = 1 / (1 + np.exp(-np.clip(self.margins(flat, n), -35, 35))) - labels[pick]
                row = np.repeat(np.arange(len(pick)), n)
                sums = np.zeros((len(pick), FACTORS))
                np.add.at(sums, row, self.vectors[flat])
                used, code = np.unique(flat, return_inverse=True)
                w = np.bincount(code, error[row], len(used)) / len(pick) + DECAY * self.weights[used]
                v = np.zeros((len(used), FACTORS))
                np.add.at(v, code, error[row, None] * (sums[row] - self.vectors[flat]))
                v = v / len(pick) + DECAY * self.vectors[used]
                b = error.mean()
                g_bias += b * b
                g_w[used] += w * w
                g_v[used] += v * v
                self.bias -= RATE * b / np.sqrt(g_bias)
                self.weights[used] -= RATE * w / np.sqrt(g_w[used])
                self.vectors[used] -= RATE * v / np.sqrt(g_v[used])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Machine:
    sample = training_sample(docs, labels, "toxic", rows)
    known = saved(sample.mapInArrow(_term_rows, "label int, terms array<int>"), "toxicity-terms")
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0))).first()
    if not n:
        return Machine([], -np.inf)
    if not 0 < toxic < n:
        share = (toxic + 0.5) / (n + 1)
        return Machine([], float(np.log(share / (1 - share))))
    share = toxic / n
    counted = known.select((F.col("label") > 0).cast("long").alias("t"), F.explode("terms").alias("term"))
    counted = counted.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t"))
    expected = F.col("n") * F.lit(share)
    z2 = (F.col("t") - expected) ** 2 / (expected * F.lit(1 - share))
    chosen = (
        counted.where(F.col("n") >= LEAST_DOCS).withColumn("z2", z2).where(F.col("z2") >= LEAST_Z2)
        .orderBy(F.desc("z2"), "term").limit(TERMS)
    )
    machine = Machine([r[0] for r in chosen.select("term").collect()], float(np.log(share / (1 - share))))
    number = {b: k for k, b in enumerate(machine.buckets)}

    def pick(batches):
        for batch in batches:
            found = [[number[t] for t in terms if t in number] for terms in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(found, pa.list_(pa.int32()))], names=["label", "terms"]
            )

    # bounded: SAMPLE_ROWS rows of the chosen terms; sorted, as the order of tasks is open
    data = known.mapInArrow(pick, "label int, terms array<int>").collect()
    data = sorted((r["label"], r["terms"]) for r in data)
    if machine.buckets:
        machine.fit(
            [np.array(t, np.int64) for _, t in data], np.array([int(y > 0) for y, _ in data], float)
        )
    return machine


def _scorer(machine: Machine):
    def run(batches):
        terms = Terms({b: k for k, b in enumerate(machine.buckets)})
        for batch in batches:
            scores = []
            for _, texts in text_slices(batch, "_body"):
                found = [sorted(terms(t)) for t in texts]
                flat = np.array([x for f in found for x in f], np.int64)
                margin = machine.margins(flat, np.array([len(f) for f in found]))
                with np.errstate(over="ignore"):  # minus infinity is a score of 0
                    scores.append(1 / (1 + np.exp(-margin)))
            rest = [c for c in batch.schema.names if c != "_body"]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(scores, pa.float64())], names=[*rest, "_toxicity"]
            )

    return run


def score(docs: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` with ``_toxicity`` from 0 to 1."""
    own = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("text", F.lit("")).alias("_body"))
    rest = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema if f.name != "_body")
    return own.mapInArrow(_scorer(machine), rest + "_toxicity double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted."""
    return score(docs, train(docs, labels), ["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), F.col("_toxicity").alias("score"),
        (F.col("_toxicity") >= 0.5).cast("int").alias("predicted"),
    )
