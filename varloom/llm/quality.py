"""Quality by a linear-chain conditional random field over lines (operator 8).

Every line of a document is good or bad. Its evidence are shares of character
classes, repetition and word shape, of the line and of both neighbours; moves
between the two labels are learned too. Forward and backward passes give each
line's probability of being good; their mean, weighted by line length, is
calibrated into the document's score.

Labels exist per document only. Training starts with the document's label on
every line, then lets lines of bad documents that look good be good, and fits
the chain on those labels. It reads a bounded sample that is not held out.

Defined cases: a missing or empty text is one empty line; without any label the
score is 1; a class that no label has gives the share of the other; rows that
share an id are scored one by one; other columns are kept.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import text_slices
from varloom.llm.labelled import held_out, training_sample

#: Labelled documents that training reads at most, and lines such a document may have.
SAMPLE_ROWS, SAMPLE_LINES = 4_000, 1_000
OWN = 13
STEPS, RATE, DECAY = 120, 0.1, 1e-4
THRESHOLD = 0.3


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts, characters of each line, lines of each text."""
    whole = "\n".join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.concatenate((np.flatnonzero(codes == 10), [len(codes)]))
    begins = np.concatenate(([0], ends[:-1] + 1))
    chars = ends - begins
    counts = np.array([t.count("\n") + 1 for t in texts], np.int64)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (sums[ends] - sums[begins]) / np.maximum(chars, 1)

    upper = (codes >= 65) & (codes <= 90) | (codes >= 0xC0) & (codes <= 0xDE) & (codes != 0xD7)
    lower = (codes >= 97) & (codes <= 122) | (codes >= 0xDF) & (codes != 0xF7)
    digit = (codes >= 48) & (codes <= 57)
    space = (codes == 32) | (codes == 9)
    plain = np.isin(codes, np.array([ord(c) for c in ".,;:'\"()-?"], np.uint32))
    loud = codes == 33
    bar = codes == 124
    sign = ~(upper | lower | digit | space | plain | loud | bar | (codes == 10))
    x = np.zeros((len(ends), OWN))
    for k, mask in enumerate((upper, lower, digit, space, plain, loud, bar, sign)):
        x[:, k] = share(mask)
    lines = whole.split("\n")
    for k, line in enumerate(lines):
        words = line.split()
        n = len(words)
        if n:
            x[k, 8] = sum(map(eq, words, words[1:])) / n
            x[k, 9] = len(set(words)) / n
            x[k, 10] = min(chars[k] / n, 40) / 40
    x[:, 11] = np.log1p(chars) / 10
    x[:, 12] = chars == 0
    return x, chars, counts


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Features of the line, of the one before and of the one after, and a constant."""
    starts = np.cumsum(counts) - counts
    out = np.zeros((len(x), 3 * x.shape[1] + 1))
    n = x.shape[1]
    out[:, :n] = x
    out[1:, n : 2 * n] = x[:-1]
    out[:-1, 2 * n : 3 * n] = x[1:]
    out[starts, n : 2 * n] = 0
    out[starts + counts - 1, 2 * n : 3 * n] = 0
    out[:, -1] = 1
    return out


def marginals(emission: np.ndarray, moves: np.ndarray, counts: np.ndarray):
    """Per line the probability of good; per text the expected moves.

    ``emission`` is the log odds of good from the line alone, ``moves`` the
    log weights of label changes. All texts advance by one line per step, from
    the longest on, so that the active ones are a prefix.
    """
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    starts = (np.cumsum(counts) - counts)[order]
    step = np.exp(moves)
    odds = np.clip(emission, -30, 30)
    weight = np.stack((1 / (1 + np.exp(odds)), 1 / (1 + np.exp(-odds))), 1)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    ahead, back = np.zeros_like(weight), np.ones_like(weight)
    for t in range(longest):
        at = starts[: active[t]] + t
        a = weight[at] if t == 0 else weight[at] * (ahead[at - 1] @ step)
        ahead[at] = a / a.sum(1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        b = (weight[at + 1] * back[at + 1]) @ step.T
        back[at] = b / b.sum(1, keepdims=True)
        pair = ahead[at][:, :, None] * step[None] * (weight[at + 1] * back[at + 1])[:, None, :]
        expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
    both = ahead * back
    return both[:, 1] / both.sum(1), expected


class Field:
    """Scaling, weights, moves and calibration of a trained field."""

    def __init__(self, constant: float | None = None):
        self.constant = constant
        self.mean, self.scale = np.zeros(OWN), np.ones(OWN)
        self.weights, self.moves = np.zeros(3 * OWN + 1), np.zeros((2, 2))
        self.slope, self.shift = 1.0, 0.0

    def inputs(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return with_neighbours((x - self.mean) / self.scale, counts)

    def fit(self, x, chars, counts, labels) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        inputs = self.inputs(x, counts)
        of_doc = np.repeat(labels, counts)
        target = of_doc.astype(float)
        self._climb(inputs, counts, target, chain=False)
        alone = 1 / (1 + np.exp(-np.clip(inputs @ self.weights, -30, 30)))
        relabelled = np.where((of_doc == 0) & (alone > 0.7), 1.0, target)
        starts = np.cumsum(counts) - counts
        worst = np.minimum.reduceat(alone, starts)  # a bad document keeps its worst lines
        relabelled[(of_doc == 0) & (alone <= np.repeat(worst, counts))] = 0
        self._climb(inputs, counts, relabelled, chain=True)
        self._calibrate(self.mean_good(x, chars, counts), labels)

    def _climb(self, inputs, counts, target, chain: bool) -> None:
        """Adam steps on the conditional likelihood of the line labels."""
        before = np.ones(len(target), bool)
        before[np.cumsum(counts) - 1] = False
        here = np.flatnonzero(before)
        seen = np.zeros((2, 2))
        np.add.at(seen, (target[here].astype(int), target[here + 1].astype(int)), 1)
        theta = np.concatenate((self.weights, self.moves.ravel()))
        m, v, n = np.zeros_like(theta), np.zeros_like(theta), len(target)
        for step in range(1, STEPS + 1):
            self.weights, self.moves = theta[:-4], theta[-4:].reshape(2, 2)
            good, expected = marginals(inputs @ self.weights, self.moves, counts)
            grad = np.concatenate((inputs.T @ (good - target), (expected - seen).ravel() * chain)) / n
            grad += DECAY * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights, self.moves = theta[:-4], theta[-4:].reshape(2, 2)

    def mean_good(self, x, chars, counts) -> np.ndarray:
        good, _ = marginals(self.inputs(x, counts) @ self.weights, self.moves, counts)
        starts = np.cumsum(counts) - counts
        length = chars + 1.0
        return np.add.reduceat(good * length, starts) / np.add.reduceat(length, starts)

    def _calibrate(self, mean: np.ndarray, labels: np.ndarray) -> None:
        z = _logit(mean)
        design, theta = np.stack((z, np.ones_like(z)), 1), np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
            curve = design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
            move = np.linalg.solve(curve, design.T @ (p - labels) + 1e-2 * (theta - [1.0, 0.0]))
            theta = theta - np.clip(move, -1, 1)
        self.slope, self.shift = max(float(theta[0]), 1e-3), float(theta[1])

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z = _logit(self.mean_good(*line_features(texts)))
        return 1 / (1 + np.exp(-(self.slope * z + self.shift)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _feature_rows(batches):
    for batch in batches:
        labels = batch.column("label")
        for start, texts in text_slices(batch, "text"):
            x, chars, counts = line_features(texts)
            cuts = np.cumsum(counts)[:-1]
            yield pa.RecordBatch.from_arrays(
                [labels.slice(start, len(texts)),
                 pa.array([a.ravel() for a in np.split(x.astype(np.float32), cuts)], pa.list_(pa.float32())),
                 pa.array(np.split(chars, cuts), pa.list_(pa.int64()))],
                names=["label", "features", "chars"],
            )


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Field:
    short = F.size(F.split("text", "\n")) <= SAMPLE_LINES
    sample = training_sample(docs, labels, "quality", rows, short)
    data = sample.mapInArrow(_feature_rows, "label int, features array<float>, chars array<long>").collect()
    data = sorted((int(r["label"] > 0), r["chars"], r["features"]) for r in data)  # bounded by the sample
    if not data:
        return Field(1.0)
    y = np.array([r[0] for r in data], float)
    if y.min() == y.max():
        return Field((y.sum() + 0.5) / (len(y) + 1))
    field = Field()
    field.fit(
        np.concatenate([np.array(r[2]).reshape(-1, OWN) for r in data]),
        np.concatenate([np.array(r[1]) for r in data]), np.array([len(r[1]) for r in data]), y,
    )
    return field


def _scorer(field: Field):
    def run(batches):
        for batch in batches:
            scores = [field.score(texts) for _, texts in text_slices(batch, "_body", 1024)]
            rest = [c for c in batch.schema.names if c != "_body"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(np.concatenate(scores) if scores else [], pa.float64())],
                names=[*rest, "_quality"],
            )

    return run


def score(docs: DataFrame, field: Field, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` with ``_quality`` from 0 to 1."""
    own = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("text", F.lit("")).alias("_body"))
    rest = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema if f.name != "_body")
    return own.mapInArrow(_scorer(field), rest + "_quality double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted."""
    return score(docs, train(docs, labels), ["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), F.col("_quality").alias("score"),
        (F.col("_quality") >= THRESHOLD).cast("int").alias("predicted"),
    )
