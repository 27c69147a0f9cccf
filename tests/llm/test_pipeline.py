from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_text_operators import plain_lines, plain_near, shared_ids
from varloom.llm import quality, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    first = P.drop_toxic(spark, docs, SF).cache()
    scores = toxicity.digest(docs, labels).where("predicted = 0").select("doc_id")
    assert first.columns == columns and sorted(r[0] for r in first.select("doc_id").collect()) == sorted(r[0] for r in scores.collect())
    second = P.drop_low_quality(spark, first, SF).cache()
    scores = quality.digest(first, labels).where("predicted = 1").select("doc_id")
    assert second.columns == columns and sorted(r[0] for r in second.select("doc_id").collect()) == sorted(r[0] for r in scores.collect())
    third = P.drop_repeated_lines(spark, second, SF).cache()
    rows = [(r.doc_id, r.text) for r in second.collect()]
    kept = third.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")).collect()
    assert third.columns == columns and sorted((r.doc_id, r.h) for r in kept) == sorted((i, h) for i, _, _, h in plain_lines(rows))
    fourth = P.drop_near_copies(spark, third, SF).cache()
    rows = [(r.doc_id, r.text) for r in third.collect()]
    want = sorted(i for i, _, _, stays in plain_near(rows) if stays)
    assert fourth.columns == columns and sorted(r[0] for r in fourth.select("doc_id").collect()) == want
    packed = P.pack_sequences(spark, fourth, SF)
    assert sorted(r[0] for r in packed.select("doc_id").distinct().collect()) == want


def test_stages_on_odd_rows(spark, make_docs):
    odd = make_docs([(1, None), (2, ""), (None, "x y"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "A B C D E F"), (None, None)])
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns
        assert stage(spark, odd.where(F.col("doc_id") < 0), SF).count() == 0
    stays = P.drop_near_copies(spark, odd, SF)
    assert sorted((r.doc_id or 0) for r in stays.collect()) == [0, 0, 1, 2, 3]
    lines = P.drop_repeated_lines(spark, odd, SF)
    assert lines.count() == 7


def test_near_copies_keep_unique_texts_of_a_shared_id(spark, make_docs):
    rows = shared_ids()
    got = [(r.doc_id, r.text) for r in P.drop_near_copies(spark, make_docs(rows), SF).collect()]
    texts = [t for _, t in rows]
    assert sorted(t for i, t in got if i in (3, 9)) == sorted([texts[0], texts[2], texts[3], texts[9]])
    assert sum(i == 20 for i, _ in got) == 1 and not any(i in (12, 21) for i, _ in got)
    assert {t for i, t in got if i == 8} == {"", " ", None} and len(got) == 8


def test_stages_keep_columns_of_any_name(spark):
    names = ["_id", "_text_key", "_body", "_doc", "_version", "_kept", "_toxicity", "_quality", "keep_bitmap", "given0", "group", "a.b"]
    rows = [(k, f"line number one of {k}\nshared line of all documents\nword{k} other{k} more{k} again{k}", "x", *names) for k in range(6)]
    schema = "doc_id long, text string, n_chars string, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs.withColumn("n_chars", F.lit(1).cast("long")), SF)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert list(r)[3:] == names, name
    assert P.pack_sequences(spark, docs, SF).count() == 6
