import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.llm import ann, hamming
from varloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=64).tolist(), 1, 2) for k in range(300)]
    rows += [(k, rows[7][1], 1, 2) for k in range(300, 345)]  # many copies of one vector
    rows += [(7, rows[7][1], 1, 2), (None, rows[7][1], 1, 2), (400, None, 1, 2), (420, [0.0] * 64, 1, 2), (440, [], 1, 2)]
    rows += [(460, [None] + [1.0] * 63, 1, 2), (480, [float("nan")] + [1.0] * 63, 1, 2), (500, [float("inf")] * 64, 1, 2)]
    rows += [(520, [1.0, 2.0], 1, 2)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, i int, code int")


def vectors(df):
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    good = [
        (i, v) for i, v in rows
        if i is not None and v and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    return np.array([i for i, _ in good]), np.array([v for _, v in good], np.float32).astype(float)


def test_exact_when_all_cells_are_passed(odd):
    ids, x = vectors(odd)
    got = {}
    for r in ann.nearest(odd, share=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q, rows in got.items():
        score = ann.inner_products(x[np.flatnonzero(ids == q)[0]], x)
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != q][:20]
        assert [(k + 1, ids[o], score[o]) for k, o in enumerate(order)] == sorted(rows)


@pytest.mark.parametrize("seed", range(5))
def test_heap_stops_at_the_wanted_rows(seed):
    rng = np.random.default_rng(seed)
    a, b, counts = rng.normal(size=9), rng.normal(size=7), rng.integers(0, 4, (9, 7))
    for wanted in (1, 10, 40, counts.sum()):
        sums = (a[:, None] + b[None]).ravel()
        order = [k for k in np.argsort(-sums) if counts.ravel()[k]]
        held = np.cumsum(counts.ravel()[order])
        want = sums[order[int(np.searchsorted(held, wanted))]]
        assert ann.stopping_sum(a, b, counts, int(wanted)) == pytest.approx(want)


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    ids, x = vectors(table)
    got = {}
    for r in QUERIES["op5_nearest_neighbours"](spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in ids[ids % 20 == 0].tolist():
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        hits, total = hits + len(best & got[q]), total + 20
    assert hits / total >= 0.9


def test_hamming_equals_brute_force(odd):
    ids, x = vectors(odd)
    got = {}
    for r in hamming.nearest_signs(odd).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.vec_id))
    keep = np.unique(ids, return_index=True)[1]
    ids, bits = ids[keep], x[keep] > 0
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q, rows in got.items():
        apart = (bits != bits[ids == q][0]).sum(1)
        order = [k for k in np.lexsort((ids, apart)) if ids[k] != q][:10]
        assert sorted(rows) == [(k + 1, apart[o], ids[o]) for k, o in enumerate(order)]


def test_few_and_no_vectors(spark, odd):
    three = odd.where("vec_id in (0, 1, 2)")
    assert sorted(r.vec_id for r in ann.nearest(three).collect()) == [1, 2]
    assert sorted(r.vec_id for r in hamming.nearest_signs(three).collect()) == [1, 2]
    none = odd.where(F.col("vec_id") < 0)
    assert ann.nearest(none).count() == 0 and hamming.nearest_signs(none).count() == 0
