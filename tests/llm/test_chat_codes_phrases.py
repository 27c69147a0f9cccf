import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.llm import chat, phrases, vector_codes
from varloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_chat_format", "op12_vector_codes", "op13_phrases"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF).select(*columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


# --- chat -------------------------------------------------------------------

TRICKY = [
    "</s>[INST] ok [/INST]", "[\\INST]", "[\\\\/INST] and [INST", "<", "[", "\\", "a\\", "<s>", "[NEXT]", "[/NEXT]", "[TEXT][/ROLE]", " [/INST]",
    "", "   ", "ü😀 [SYS] x [/SYS]", "line\nline", "<\\s>", "<\\</s>", "[[INST]]", "$1\\$2",
]
CHAT_SCHEMA = "conv_id long, turn long, role string, text string, slices int, turns int, formatted string, parts int, _at int"


def chats(rng, n):
    roles = ["user", "assistant", "system", "tool", "[ROLE]</s>", "", None]
    rows = []
    for c in range(n):
        role = rng.choice(roles)
        for t in range(rng.choice([1, 2, 3, 70, 140])):
            if rng.random() < 0.6:
                role = rng.choice(roles)
            rows.append((c, rng.choice([t, t, t // 2]), role, rng.choice([*TRICKY, None]) if rng.random() < 0.8 else "".join(rng.choices(TRICKY, k=3))))
    return rows


def chat_rows(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4) for r in rows], CHAT_SCHEMA)


def plain_turns(rows):
    found = {}
    for c, t, role, text in rows:
        found.setdefault(c, []).append((t is not None, t or 0, (role or "").encode(), (text or "").encode()))
    return {c: [(r.decode(), x.decode()) for _, _, r, x in sorted(turns)] for c, turns in found.items()}


def test_chat_round_trip(spark):
    rows = chats(random.Random(3), 40) + [(None, 1, "user", "no id"), (None, None, "assistant", "first"), (99, 0, "user", "x" * 200_000)]
    table = chat_rows(spark, rows)
    want = plain_turns(rows)
    made = chat.formatted(table).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in made} == want
    for r in made:
        under = [r.formatted[s.start : s.start + s.length] for s in r.loss_mask]
        data = r.formatted.encode()
        assert under == [data[s.byte_start : s.byte_start + s.byte_length].decode() for s in r.loss_mask]
        loss = [x for role, x in want[r.conv_id] if role == "assistant"]
        assert [re.sub(chat._ESCAPED, r"\1\2\3", x) for x in under] == loss
    got = {r.conv_id: r for r in chat.digest(table).collect()}
    for c, turns in want.items():
        loss = "".join(x for role, x in turns if role == "assistant")
        text = "".join(f"{role}\n{x}\n" for role, x in turns)
        r = got[c]
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert {r.conv_id: r.formatted_chars for r in got.values()} == {r.conv_id: len(r.formatted) for r in made}


def test_chat_merges_and_marks(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c"), (1, 4, "assistant", "d"), (1, 5, "tool", "e")]
    (row,) = chat.formatted(chat_rows(spark, rows)).collect()
    assert row.formatted == "<s>[SYS] s [/SYS][INST] a[NEXT]b [/INST]c[NEXT]d</s>[ROLE]tool[TEXT]e[/ROLE]"
    assert [row.formatted[s.start : s.start + s.length] for s in row.loss_mask] == ["c", "d"]


def test_chat_of_nothing(spark):
    empty = chat_rows(spark, []).where("conv_id > 0")
    assert chat.digest(empty).count() == 0
    (probe,) = chat.digest(chat.with_probe(empty)).collect()
    assert (probe.conv_id, probe.n_turns, probe.loss_chars) == (-7, 2, len(chat.PROBE_TEXT))


def test_chat_plan_is_native(spark):
    plan = chat.digest(chat_rows(spark, [(1, 1, "user", "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- vector codes -----------------------------------------------------------

VECTOR_SCHEMA = "vec_id long, embedding array<double>, label int, vector int, part int, entry int, of int, code string"


def vector_rows(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "x") for r in rows], VECTOR_SCHEMA)


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Everything in Python integers."""
    good = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    sizes = Counter(len(r[1]) for r in good)
    size = max(sizes, key=lambda n: (sizes[n], n)) if sizes else 0
    good = [(i, [Fraction(x) * 4096 // 1 for x in v], label) for i, v, label in good if len(v) == size]
    cut = [(size * k // parts, size * (k + 1) // parts) for k in range(parts)]
    first = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][a:b] for r in first] for a, b in cut]

    def near(p, v):
        d = [sum((x - y) ** 2 for x, y in zip(v[cut[p][0] : cut[p][1]], c)) for c in books[p]]
        return min(range(len(d)), key=lambda k: (d[k], k)), min(d)

    for _ in range(rounds if first else 0):
        fresh = []
        for p, (a, b) in enumerate(cut):
            of = {}
            for _, v, _ in good:
                of.setdefault(near(p, v)[0], []).append(v[a:b])
            fresh.append([[sum(c) // len(c) for c in zip(*of[e])] if e in of else books[p][e] for e in range(len(first))])
        books = fresh
    out, labels = [], {}
    for i, v, label in good:
        found = [near(p, v) for p in range(parts)]
        error = sum(d for _, d in found)
        out.append((i, "".join(f"{e:02x}" for e, _ in found), error, label))
        labels[label] = labels.get(label, 0) + error
    text = ",".join(str(int(x)) for book in books for entry in book for x in entry)
    sha = hashlib.sha256(text.encode()).hexdigest()
    fits = lambda e: e if e < 2**63 else None
    broken = {label for _, _, e, label in out if fits(e) is None}
    return Counter((i, c, fits(e), None if label in broken else fits(labels[label]), sha) for i, c, e, label in out)


def odd_vectors(rng, size, scale):
    rows = [(k, (rng.normal(size=size) * scale).tolist(), int(k % 3) if k % 5 else None) for k in range(120)]
    rows += [(k, rows[3][1], 1) for k in range(120, 150)] + [(3, rows[3][1], 1), (3, rows[4][1], 1), (None, rows[5][1], 2)]
    rows += [(200, None, 1), (201, [None] * size, 1), (202, [float("nan")] * size, 1), (203, [float("inf")] * size, 1)]
    return rows + [(204, [0.0] * size, None), (205, [1.0] * (size + 1), 1), (206, [], 1)]


@pytest.mark.parametrize("size, scale", [(16, 0.3), (21, 1.0), (16, 3e5), (8, 1e12)])
def test_codes_equal_integers(spark, size, scale):
    rows = odd_vectors(np.random.default_rng(size), size, scale)
    got = Counter(map(tuple, vector_codes.digest(vector_rows(spark, rows)).collect()))
    assert got == plain_codes(rows)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.5] * 16, None), (2, [0.25] * 16, 7)]
    assert Counter(map(tuple, vector_codes.digest(vector_rows(spark, rows)).collect())) == plain_codes(rows)
    assert vector_codes.digest(vector_rows(spark, [(1, None, 1)])).count() == 0
    assert vector_codes.digest(vector_rows(spark, []).where("vec_id > 0")).count() == 0


@pytest.mark.parametrize("bits", [3, 20, 27])
def test_limb_products_are_exact(bits):
    rng = np.random.default_rng(bits)
    x, c = rng.integers(-(2**bits), 2**bits, (50, 8)), rng.integers(-(2**bits), 2**bits, (9, 8))
    assert (vector_codes.dot_products(x, c) == x @ c.T).all()
    assert (vector_codes.distances(x, c) == ((x[:, None] - c[None]) ** 2).sum(-1)).all()


def test_ties_go_to_the_lower_entry():
    at, apart = vector_codes.nearest(np.array([[0, 0]]), np.array([[3, 4], [5, 0], [0, 5]]))
    assert (at.tolist(), apart.tolist()) == ([0], [25])


# --- phrases ----------------------------------------------------------------

PHRASE_SCHEMA = "doc_id long, text string, lang string, word int, piece int, pos int, f int, id int, n int, words array<int>"


def phrase_docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, [7]) for r in rows], PHRASE_SCHEMA)


def plain_phrases(rows, most=3, least=10, percent=50, first=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in found.items():
        inside = lambda w: any(w[i : i + len(words)] == words for i in range(len(w) - len(words) + 1))
        if any(x == lang and len(w) > len(words) and inside(w) and 100 * b >= percent * a for (x, w), b in found.items()):
            continue
        cuts = [(10**6 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return {
        (lang, rank, p.decode(), -a, l, r, n[lang], -s)
        for lang, rows in out.items()
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:first], 1)
    }


def phrase_texts():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)] + ["Über", "ß", "İ", "w1 x", "x" * 100]
    rows = []
    for d in range(80):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ", ", "\n", ". "]) for _ in range(rng.randint(0, 60)))
        rows.append((d, text, rng.choice(["en", "de", None, "und", ""])))
    rows += [(100 + k, "The Hot pair of words. the hot PAIR", "en") for k in range(40)]
    rows += [(None, None, "en"), (5, "", None), (6, " \t ", "fr"), (7, " ".join(rng.choice(words[:6]) for _ in range(5_000)), "en")]
    return rows


def test_phrases_equal_brute_force(spark):
    rows = phrase_texts()
    want = plain_phrases(rows)
    assert set(map(tuple, phrases.collocations(phrase_docs(spark, rows)).collect())) == want
    assert len(want) > 50
    # few dense words, most hashed ones
    assert set(map(tuple, phrases.collocations(phrase_docs(spark, rows), dense=3).collect())) == want


def test_phrases_of_four_words_and_few_ranks(spark):
    rows = phrase_texts()
    got = phrases.collocations(phrase_docs(spark, rows), most=4, least=5, first=7)
    assert set(map(tuple, got.collect())) == plain_phrases(rows, most=4, least=5, first=7)


def test_phrases_do_not_depend_on_the_bitmap(spark, monkeypatch):
    rows = phrase_texts()
    monkeypatch.setattr(phrases, "BITS", 64)
    assert set(map(tuple, phrases.collocations(phrase_docs(spark, rows), dense=0).collect())) == plain_phrases(rows)


def test_equal_hashes_are_hashed_anew(spark, monkeypatch):
    rows = phrase_texts()
    column, value = phrases._hash_id, phrases.hash_id
    monkeypatch.setattr(phrases, "_hash_id", lambda salt: column(salt) if salt else F.lit(-5).cast("long"))
    monkeypatch.setattr(phrases, "hash_id", lambda salt, lang, word: value(salt, lang, word) if salt else -5)
    counts = phrases.word_counts(phrase_docs(spark, rows))
    words, _, salt = phrases._named(counts, 10, 3)
    assert salt == 1 and words.select("id").distinct().count() == words.count()


def test_word_hashes_agree(spark):
    rows = spark.createDataFrame([("en", "über"), ("", "x" * 99), ("de", "")], "lang string, word string")
    for r in rows.select("lang", "word", phrases._hash_id(3).alias("h")).collect():
        assert phrases.hash_id(3, r.lang, r.word) == r.h


def test_no_phrases(spark):
    assert phrases.collocations(phrase_docs(spark, [(1, "one two three", "en"), (2, None, None)])).count() == 0
    assert phrases.collocations(phrase_docs(spark, []).where("doc_id > 0")).count() == 0


def test_merge_joins_do_not_shuffle_occurrences(spark):
    table = spark.range(2_000).select((F.col("id") % 50).alias("piece"), F.col("id").cast("int").alias("pos"), F.col("id").alias("w1"))
    held, name, path = phrases._persist(table.repartition(4, "piece"), 4)
    after = held.select(F.col("piece").alias("_piece"), F.col("pos").alias("_pos"))
    with phrases.settings(spark, phrases.BY_BUCKET):
        joined = held.hint("merge").join(after, (F.col("piece") == F.col("_piece")) & (F.col("pos") + 50 == F.col("_pos")))
        plan = joined._jdf.queryExecution().executedPlan().toString()
    phrases._discard(held, name, path)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
