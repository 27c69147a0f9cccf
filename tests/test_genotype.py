import itertools

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varloom.functions import genotype as G


def facts(gt):
    """Plain-Python reading of a call."""
    tokens = [] if gt in (None, ".", "./.", ".|.") else gt.replace("|", "/").split("/")
    called = bool(tokens) and "." not in tokens
    return {
        "called": called,
        "alt": called and any(t != "0" for t in tokens),
        "ref": called and all(t == "0" for t in tokens),
        "het": called and len(tokens) == 2 and tokens[0] != tokens[1],
        "hom": called and len(tokens) == 2 and tokens[0] == tokens[1] != "0",
    }


def spark_facts(spark, calls):
    gt = F.col("gt")
    df = spark.createDataFrame([(i, c) for i, c in enumerate(calls)], "i int, gt string").select(
        "i",
        G.gt_called(gt).alias("called"),
        G.gt_has_alt(gt).alias("alt"),
        G.gt_is_ref(gt).alias("ref"),
        G.gt_is_het(gt).alias("het"),
        G.gt_is_hom_alt(gt).alias("hom"),
    )
    return [{k: r[k] for k in ("called", "alt", "ref", "het", "hom")} for r in df.orderBy("i").collect()]


def test_all_short_calls(spark):
    tokens = [".", "0", "1", "2", "12"]
    calls = [None, *tokens, *[a + s + b for a, b in itertools.product(tokens, tokens) for s in "/|"]]
    assert spark_facts(spark, calls) == [facts(c) for c in calls]


token = st.sampled_from(["0", "1", "2", "3", "."])
call = st.one_of(st.none(), token, st.tuples(token, st.sampled_from("/|"), token).map("".join))


@settings(max_examples=3, deadline=None)
@given(st.lists(call, min_size=30, max_size=60))
def test_random_calls(spark, calls):
    assert spark_facts(spark, calls) == [facts(c) for c in calls]


def test_zygosity_and_state(spark):
    rows = [
        ("0/1", "heterozygous"), ("1|1", "homozygous_alternate"), ("0/0", "reference"), ("1", "hemizygous"),
        ("0", "reference"), ("1/2", "compound_alternate"), ("./.", None), (None, None),
    ]
    df = spark.createDataFrame(rows, "gt string, want string")
    assert df.where(~G.zygosity(F.col("gt")).eqNullSafe(F.col("want"))).count() == 0
    states = [("0/1", "heterozygous"), ("1/1", "homozygous_alt"), ("1", "haploid_alt"), ("0|0", "reference"), ("./1", "unknown"), (None, "unknown")]
    df = spark.createDataFrame(states, "gt string, want string")
    assert df.where(G.genotype_state(F.col("gt")) != F.col("want")).count() == 0


def test_projection(spark):
    rows = [("0/1", 1, "0/1"), ("1|2", 2, "0|1"), ("./2", 1, "./0"), ("12/2", 2, "0/1"), ("10/1", 1, "0/1"), ("2", 2, "1")]
    df = spark.createDataFrame(rows, "gt string, k int, want string")
    assert df.where(G.project_gt(F.col("gt"), F.col("k")) != F.col("want")).count() == 0
