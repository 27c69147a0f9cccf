import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varloom.operators import ordering
from varloom.operators import ranking as R
from varloom.operators.ordering import rank_within, running_max, with_ordinal
from varloom.sources.vcf import read_lines


def skewed(spark, n=4000):
    """A third and more of the rows in one group, with many equal scores."""
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 40}", f"id{i:05d}", rng.randint(0, 5) / 5) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "run_id string, variant_id string, score double").repartition(7)


def test_rank_equals_window(spark):
    df = skewed(spark)
    order = [F.col("score").desc(), F.col("variant_id")]
    ranked = rank_within(df, ["run_id"], order)
    window = F.row_number().over(Window.partitionBy("run_id").orderBy(*order))
    assert ranked.withColumn("w", window).where("w <> rank").count() == 0
    assert ranked.count() == 4000


def test_rank_does_not_depend_on_partitions(spark):
    df = skewed(spark, 900)
    order = [F.col("score").desc(), F.col("variant_id")]
    seen = []
    for width in ("2", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        seen.append(sorted(map(tuple, rank_within(df, ["run_id"], order).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


def test_rank_by_value_equals_window_and_writes_no_row(spark, monkeypatch):
    """NULL, NaN, infinite, negative and large values, ties; steps above the bound are placed, others are not."""
    values = [None, float("nan"), float("inf"), -float("inf"), -0.0, 0.0, -3.5, 1.0, 7.25, 1e300, 0.5, 0.5004, 0.9999]
    rows = [("hot" if i % 3 else f"g{i % 40}", f"id{i:05d}", values[i * 7 % 13] if i % 2 else (i % 97) / 97) for i in range(3000)]
    df = spark.createDataFrame(rows, "run_id string, variant_id string, score double").repartition(5)
    order = [F.col("score").desc(), F.col("variant_id")]
    window = F.row_number().over(Window.partitionBy("run_id").orderBy(*order))
    placed, place = [], ordering.place
    monkeypatch.setattr(ordering, "place", lambda rows, keys: placed.append(rows.count()) or place(rows, keys))
    for bound in (ordering.HOT_STEP, 100):
        monkeypatch.setattr(ordering, "HOT_STEP", bound)
        ranked = rank_within(df, ["run_id"], order, "rank", "score")
        assert ranked.withColumn("w", window).where("w <> rank").count() == 0 and ranked.count() == 3000
        assert sorted(ranked.columns) == sorted([*df.columns, "rank"])
    assert len(placed) == 1 and 0 < placed[0] < 3000


def test_running_max(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), "id").repartition(5)
    got = running_max(df, ["g"], [F.col("id")], F.when(F.col("id") % 100 < 2, F.col("id")), "m")
    assert got.where((F.floor(F.col("id") / 100) * 100 + F.col("g")) != F.col("m")).count() == 0


def test_ordinal(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("id")).repartition(6)
    assert with_ordinal(df, ["id"]).where("ordinal <> id + 1").count() == 0


def test_line_numbers_of_split_files(spark, tmp_path):
    for name, n in (("a.txt", 5000), ("b.txt", 10)):
        (tmp_path / name).write_text("".join(f"{i}\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    lines = read_lines(spark, str(tmp_path))
    wrong = lines.where(F.col("line_no") != F.col("value").cast("bigint")).count()
    parts = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert parts > 3 and wrong == 0 and lines.count() == 5010


def test_context_ranks_score_every_candidate_once(spark):
    """Ranks of the separate way, with branches; placing reads saved scores, so rounding runs once a row."""
    rows = [("r", f"v{i:03d}", (i % 7) / 7, (i % 5) / 5, ["all", "conservative"] + (["ensemble"] if i % 3 else [])) for i in range(200)]
    table = spark.createDataFrame(rows, "run_id string, variant_id string, a double, b double, branches array<string>")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    features = table.withColumn(
        "features", F.struct(F.col("a").alias("quality"), F.col("b").alias("rarity"), *[F.lit(0.5).alias(n) for n in ("consequence", "phenotype", "inheritance")])
    )
    counted = features.mapInArrow(count, features.schema)
    keys = ["run_id", "context", "variant_id", "score", "rank"]
    got = sorted(map(tuple, R.context_ranks(counted).select(*keys).collect()))
    assert seen.value == 200
    assert got == sorted(map(tuple, R.rank_candidates(R.context_scores(features).select(*keys[:-1])).collect()))


def test_contexts_of_equal_scores_are_placed_once(spark, monkeypatch):
    """28 contexts hold 23 orders: the ranks of every context are as before, 23 rows a candidate are placed."""
    rows = [("r", f"v{i:02d}", (i % 7) / 7, (i % 5) / 5, ["all", "conservative", "ensemble"]) for i in range(40)]
    table = spark.createDataFrame(rows, "run_id string, variant_id string, a double, b double, branches array<string>")
    features = table.withColumn(
        "features", F.struct(F.col("a").alias("quality"), F.col("b").alias("rarity"), *[F.col("a").alias(n) for n in ("consequence", "phenotype", "inheritance")])
    )
    placed = []

    def counted(df, *args):
        placed.append(df.count())
        return rank_within(df, *args)

    monkeypatch.setattr(R, "rank_within", counted)
    keys = ["run_id", "context", "variant_id", "score", "rank"]
    got = sorted(map(tuple, R.context_ranks(features).select(*keys).collect()))
    assert placed == [23 * 40]
    assert got == sorted(map(tuple, R.rank_candidates(R.context_scores(features).select(*keys[:-1])).collect()))


def test_context_ranks_by_steps_equal_the_placed_ones(spark, monkeypatch):
    rows = [(f"r{i % 3}", f"v{i:03d}", (i % 7) / 7, (i % 5) / 5, ["all", "conservative"] + (["ensemble"] if i % 3 else [])) for i in range(200)]
    table = spark.createDataFrame(rows, "run_id string, variant_id string, a double, b double, branches array<string>")
    features = table.withColumn(
        "features", F.struct(F.col("a").alias("quality"), F.col("b").alias("rarity"), *[F.lit(0.5).alias(n) for n in ("consequence", "phenotype", "inheritance")])
    )
    want = sorted(map(tuple, R.context_ranks(features).collect()))
    monkeypatch.setattr(R, "PLACED_RANKS", 0)
    monkeypatch.setattr(ordering, "place", lambda *a: None)
    assert sorted(map(tuple, R.context_ranks(features).collect())) == want


def test_label_ranks_equal_the_ablations_of_all_ranks(spark, monkeypatch):
    """Ties, a label outside a branch, one without a candidate, a repeated label and a run without one branch."""
    rows = [(f"r{i % 3}", f"v{i:03d}", (i % 7) / 7, (i % 5) / 5, ["all", "conservative"] + (["ensemble"] if i % 4 and i % 3 < 2 else [])) for i in range(200)]
    table = spark.createDataFrame(rows, "run_id string, variant_id string, a double, b double, branches array<string>")
    features = table.withColumn(
        "features", F.struct(F.col("a").alias("quality"), F.col("b").alias("rarity"), *[F.lit(0.5).alias(n) for n in ("consequence", "phenotype", "inheritance")])
    )
    labels = [("r0", "v003"), ("r0", "v009"), ("r0", "v009"), ("r1", "v004"), ("r1", "none"), ("r2", "v005")]
    truth = spark.createDataFrame(labels, "run_id string, variant_id string")
    want = sorted(map(str, R.label_ablations(R.context_ranks(features), truth).collect()))
    monkeypatch.setattr(R, "rank_within", lambda *a: None)
    assert sorted(map(str, R.label_ranks(features, truth).collect())) == want
