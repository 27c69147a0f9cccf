import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from varloom.llm import bpe, line_dedup, near_dedup, packing
from varloom.llm.common import components
from varloom.llm.word_bpe import default_path, load

ODD = [
    (1, "Hello's WORLD we'LL 12 ΑΣ ΣΣ ²³ x_y a\x1cb a\x85b İ ß 😀"), (2, None), (3, ""), (4, "   "), (5, "<|endoftext|>a <|ENDOFTEXT|>"),
    (6, "x" * 300 + " " + "ab" * 200), (7, "one two three"), (8, "one two three"), (None, "no id at all, but a long line"),
    (9, "no id at all, but a long line\nshort\nown line of nine\nshort"), (9, "another text of document nine"),
    (9, "another text of document nine"), (10, "\tNO ID at all, but a long line \n\n"), (11, "a b c d e f " * 3_000),
]


def plain_lines(rows):
    """Brute force of line dedup over (doc_id, text)."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    order = lambda i: 2**63 - 1 if i is None else i
    owners = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            owners.setdefault(key(line), set()).add(order(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or order(i) == min(owners[key(x)])]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((i, len(lines), len(lines) - len(kept), digest))
    return Counter(out)


def test_line_dedup_equals_brute_force(make_docs):
    rng = random.Random(1)
    lines = [f"common line number {k}" for k in range(12)] + ["short", "", "  Common LINE number 3 "]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 8)))) for k in rng.sample(range(1000), 150)]
    rows += [(k, "the same hot line in all\n" + str(k)) for k in range(2000, 2300)]
    for data in (rows + ODD, ODD):
        got = Counter(tuple(r) for r in line_dedup.digest(make_docs(data)).collect())
        assert got == plain_lines(data)


def test_line_dedup_bitmaps(make_docs):
    docs = make_docs([(1, "a shared long line\nx"), (2, "y\na shared long line\nz")])
    (row,) = line_dedup.keep_bitmaps(docs).collect()
    assert (row.doc, row.n_lines, row.n_dropped) == (2, 3, 1)
    assert line_dedup.unpack_bits(row.keep_bitmap, 3).tolist() == [True, False, True]
    assert set(line_dedup.drop_lines(docs).columns) == {*docs.columns, "_kept", "_n_lines", "_n_dropped"} - {"text"}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_near(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if sets[a][0] is not None and sets[b][0] is not None and x and 100 * len(x & y) >= 75 * len(x | y):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return Counter(
        (i, len(s), None if i is None else least[root(k)], i is None or least[root(k)] == i)
        for k, (i, s) in enumerate(sets)
    )


def near_rows():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, ids = [], iter(rng.sample(range(10_000), 2_000))
    for size in (1, 3, 6, 40, 120):
        for _ in range(6):
            base = [rng.choice(vocabulary) for _ in range(size)]
            for _ in range(6):
                words = [rng.choice(vocabulary) if rng.random() < 0.025 else w for w in base]
                rows.append((next(ids), " ".join(words)))
    return rows + [(i, t) for i, t in ODD if i != 9]


def test_near_duplicates_equal_brute_force(make_docs):
    rows = near_rows()
    docs = make_docs(rows)
    want = plain_near(rows)
    for block in (near_dedup.BLOCK_SHINGLES, 300):  # 300: clusters are cut into many blocks
        got = Counter(
            (r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, block=block).collect()
        )
        assert got == want


def shared_ids():
    rng = random.Random(9)
    texts = [" ".join(f"{c}{rng.randrange(400)}" for _ in range(60)) for c in "xyzab"]
    near = [t + " end" for t in texts]
    return [
        (3, texts[0]), (9, near[0]), (9, texts[1]), (9, texts[2]), (12, near[2]), (20, texts[3]), (20, near[3]), (20, texts[3]),
        (21, near[4]), (9, texts[4]), (8, ""), (8, " "), (8, None), (8, ""),
    ]


def test_rows_that_share_an_id_are_compared_by_their_own_texts(make_docs):
    for rows in (shared_ids(), near_rows() + [(i, t) for i, t in ODD if i == 9] + shared_ids()):
        want = plain_near(rows)
        for block in (near_dedup.BLOCK_SHINGLES, 100):
            got = near_dedup.near_duplicates(make_docs(rows), block=block).collect()
            assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want


def test_near_group_is_joined_without_listing_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**60, 100).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(100) < 0.07, rng.integers(0, 2**60, 100).astype(np.uint64), base)) for _ in range(150)]
    links = near_dedup.spanning_forest(sets, np.zeros(150, int))
    parent = list(range(150))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert root(a) != root(b)  # a forest
        parent[root(a)] = root(b)
    got = {frozenset(k for k in range(150) if root(k) == r) for r in {root(k) for k in range(150)}}
    parent = list(range(150))
    for a, b in itertools.combinations(range(150), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            parent[root(a)] = root(b)
    assert got == {frozenset(k for k in range(150) if root(k) == r) for r in {root(k) for k in range(150)}}


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 60) if k % 20] + [(100, k) for k in range(101, 160)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 + (k - 1) // 20 * 20 for k in range(1, 61) if (k - 1) % 20} | {k: 100 for k in range(101, 160)}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def test_bpe_equals_the_library(make_docs, library):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(make_docs(ODD)).collect()}
    want = set()
    for i, text in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.add((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == want


def test_small_lexicon_gives_the_same_ids(make_docs):
    small, large = (
        {(r.doc_id, tuple(r.ids)) for r in bpe.encode(make_docs(ODD), limit=n).select("doc_id", "ids").collect()} for n in (2, 50_000)
    )
    assert small == large


@pytest.mark.parametrize("limit", [1, 3, 40, 1_000])
def test_lexicon_words_are_the_most_frequent_ones(make_docs, limit):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("abcdefghij") * rng.choice([1, 1, 2, 3, 60]) for _ in range(60))) for k in range(40)]
    counts = Counter(w for _, text in rows for w in text.split() if len(w) <= bpe.LEXICON_BYTES)
    got = bpe.frequent_words(make_docs([*rows, (99, None), (98, "single")]), default_path(), limit)
    assert len(got) == len(set(got)) <= limit and "single" not in got
    left = max((n for w, n in counts.items() if w not in got), default=0)
    assert all(counts[w] * 2 ** (1 / 64) > left for w in got)
    assert limit < len(counts) or set(got) == set(counts)


def test_transducer_numbers_sorted_words(tmp_path):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))).encode() for _ in range(800)})
    ids = [np.array([k, k + 1]) for k in range(len(words))]
    built = bpe.Transducer.build(words, ids)
    (tmp_path / "x").write_bytes(built.to_bytes())
    mapped = bpe.Transducer.mapped(str(tmp_path / "x"))
    assert mapped.numbers(words).tolist() == list(range(len(words)))
    other = [w for w in {b"", b"zz", b"a" * 60, words[0] + b"!", words[5][:-1] + b"\xff"} if w not in words]
    assert (mapped.numbers(other) == -1).all()
    assert len(mapped.final) < sum(map(len, words)) / 2  # suffixes are shared
    assert bpe.Transducer.build([], []).numbers([b"a"]).tolist() == [-1]


def test_long_pieces_merge_like_short_ones(library):
    own = load(default_path())
    for word in ("ab" * 60, "é" * 50, "aaab" * 30, "the" * 40):
        assert own.encode_words([word])[0].tolist() == library.encode(word, add_special_tokens=False).ids


def test_packing(make_docs, library):
    rows = ODD + [(100 + k, "word " * (k * 97 % 900)) for k in range(60)]
    got = packing.pack(make_docs(rows), length=512, group_pieces=20).collect()
    left = Counter()
    for i, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        for at in range(0, len(ids), 512):
            left[i, at, len(ids[at : at + 512]), zlib.crc32(ids[at : at + 512].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == left
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 512


def test_first_fit_equals_plain_loop():
    sizes = np.sort(np.random.default_rng(1).integers(1, 100, 500))[::-1]
    free, want = [], []
    for s in sizes.tolist():
        k = next((k for k, f in enumerate(free) if f >= s), len(free))
        if k == len(free):
            free.append(100)
        want.append((k, 100 - free[k]))
        free[k] -= s
    assert list(zip(*packing.first_fit(sizes, 100))) == want


@pytest.mark.parametrize(
    "run", [line_dedup.digest, near_dedup.near_duplicates, bpe.digest, packing.pack], ids=["lines", "near", "bpe", "pack"]
)
def test_empty_tables(make_docs, run):
    docs = make_docs([(1, "x")]).where(F.col("doc_id") < 0)
    assert run(docs).count() == 0


def test_every_code_point_is_split_as_the_library_does():
    bpe, library = load(default_path()), Tokenizer.from_file(default_path())
    library.no_truncation()
    library.no_padding()
    for start in range(0, 0x110000, 2048):
        points = [c for c in range(start, start + 2048) if not 0xD800 <= c < 0xE000]
        text = " ".join(f"a{chr(c)}b {chr(c)}{chr(c)}1" for c in points)
        words = bpe.words(text)
        got = np.concatenate(bpe.encode_words(words)) if words else np.zeros(0, np.int32)
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids, hex(start)


def test_half_keys_of_one_class_make_no_candidates(spark):
    rows = [(1, [5, 6, 7, 8]), (2, [5, 1, 7, 2]), (3, [5, 3, 4, 9]), (4, [10, 11, 7, 12])]
    classes = spark.createDataFrame(rows, "node long, halves array<long>")
    # 1 and 2 share a half on both sides, 3 and 4 on one side only
    assert [tuple(r) for r in near_dedup.candidate_links(classes, 2).collect()] == [(2, 1)]
