import random

import pytest
from pyspark.sql import functions as F

from varloom.functions import genotype as G
from varloom.operators import inheritance as I
from varloom.operators import pairs as P

CALL = "struct<genotype:string,quality:double,alternate_fraction:double>"
SCHEMA = f"run_id string, row_id bigint, variant_id string, gene string, chromosome string, genotype string, calls map<string,{CALL}>"


def variant(n, p, m="0/0", f="0/0", gene="G1", chrom="1", gq=(50.0, 50.0, 50.0), vaf=None, run="r", extra=None):
    calls = {"P": (p, gq[0], vaf)}
    if m is not None:
        calls["M"] = (m, gq[1], None)
    if f is not None:
        calls["F"] = (f, gq[2], None)
    calls.update(extra or {})
    return (run, n, f"v{n:03d}", gene, chrom, p, calls)


def trio(spark, variants, sex="male", affected=True, others=()):
    people = [("r", "P", sex, affected), ("r", "M", "female", False), ("r", "F", "male", False), *others]
    individuals = spark.createDataFrame(people, "run_id string, id string, sex string, affected boolean")
    roles = spark.createDataFrame([("r", "P", "M", "F")], "run_id string, proband_id string, mother_id string, father_id string")
    df = spark.createDataFrame(variants, SCHEMA)
    return I.with_trio(df, I.pedigree_table(individuals, roles))


def fits(spark, rows, model, **kw):
    out = I.single_fits(trio(spark, rows, **kw)).select("row_id", model).collect()
    return {r[0]: r[1] for r in out}


def test_de_novo(spark):
    rows = [variant(1, "0/1"), variant(2, "0/1", m=None), variant(3, "0/1", f="./."), variant(4, "0/1", m="0/1"),
            variant(5, "0/0"), variant(6, "0/1", gq=(8.0, 50.0, 50.0)), variant(7, "0/1", vaf=0.12), variant(8, "0/1", gq=(None, None, None))]
    assert fits(spark, rows, "de_novo") == {1: 1.0, 2: 0.4, 3: 0.4, 4: 0.0, 5: 0.0, 6: 0.5, 7: 0.5, 8: 1.0}
    assert fits(spark, rows[:1], "de_novo", affected=None) == {1: 0.5}


def test_homozygous_recessive(spark):
    rows = [variant(1, "1/1", "0/1", "0|1"), variant(2, "1/1", None, "0/1"), variant(3, "1/1"), variant(4, "0/1")]
    assert fits(spark, rows, "homozygous_recessive") == {1: 1.0, 2: 0.65, 3: 0.35, 4: 0.0}


def test_x_linked(spark):
    rows = [variant(1, "1", "0/1", "0", chrom="chrX"), variant(2, "1", "0/1", None, chrom="X"), variant(3, "1", "0/1", "1", chrom="X"),
            variant(4, "1", "0/0", "0", chrom="X"), variant(5, "1", "0/1", "0"), variant(6, "0", "0/1", "0", chrom="X")]
    assert fits(spark, rows, "x_linked") == {1: 1.0, 2: 1.0, 3: 0.9, 4: 0.55, 5: 0.0, 6: 0.0}
    assert fits(spark, rows[:1], "x_linked", sex="female") == {1: 0.2}


def test_dominant_with_relatives(spark):
    rows = [variant(1, "0/1"), variant(2, "0/1", m="0/1"), variant(3, "0/1", m="0/1", extra={"S": ("0/1", 50.0, None)}), variant(4, "0/0")]
    assert fits(spark, rows, "autosomal_dominant") == {1: 1.0, 2: 0.5, 3: 0.5, 4: 0.0}
    sibling = [("r", "S", "female", True)]
    assert fits(spark, [rows[2]], "autosomal_dominant", others=sibling) == {3: 0.75}
    low = variant(5, "0/1", extra={"S": ("0/1", 5.0, None)})
    assert fits(spark, [low], "autosomal_dominant", others=sibling) == {5: 0.5}


def test_pair_phases(spark):
    def phase(a, b, **kw):
        rows = P.pair_phase(trio(spark, [a, b], **kw)).select("phase", "confidence").collect()
        return [tuple(r) for r in rows]

    maternal, paternal = variant(1, "0/1", "0/1", "0/0"), variant(2, "0/1", "0/0", "0/1")
    assert phase(maternal, paternal) == [("confirmed_trans", 0.95)]
    assert phase(maternal, variant(2, "0/1", "0/0", "0/1", gq=(9.0, 50.0, 50.0))) == [("possible_trans", 0.5)]
    assert phase(maternal, variant(2, "0/1", None, None)) == [("possible_trans", 0.65)]
    assert phase(variant(1, "0/1", None, None), variant(2, "0/1", None, None)) == [("unknown", 0.55)]
    assert phase(variant(1, "0|1", None, None), variant(2, "1|0", None, None)) == [("possible_trans", 0.7)]
    assert phase(maternal, variant(2, "0/1", "0/1", "0/0")) == [("unknown", 0.25)]
    assert phase(maternal, variant(2, "0/1", "0/0", "0/1", gene="G2")) == []
    assert phase(maternal, variant(2, "0/1", "0/0", "0/1", chrom="2")) == []
    assert phase(variant(1, "0/1", gene=" unknown "), variant(2, "0/1", gene=" unknown ")) == []


def random_variants(seed, n, genes):
    rng = random.Random(seed)
    gts = ["0/1", "0|1", "1|0", "1/1", "0/0"]
    parents = ["0/1", "0/0", "./.", "1/1", None]
    return [
        variant(i, rng.choice(gts), rng.choice(parents), rng.choice(parents), gene=rng.choice(genes), chrom=rng.choice("12"),
                gq=(rng.choice([10.0, 50.0, None]), 50.0, rng.choice([10.0, 50.0])), vaf=rng.choice([None, 0.1, 0.5]))
        for i in range(1, n + 1)
    ]


@pytest.mark.parametrize("affected", [True, None])
def test_best_pair_equals_listing_every_pair(spark, affected):
    """The class form against all pairs, including which pair wins equal scores."""
    t = trio(spark, random_variants(5, 90, ["A", "b", "B", "UNKNOWN", None]), affected=affected)
    listed = P.pair_phase(t)
    quality = {r[0]: r[1] for r in t.select("variant_id", "trio_quality").collect()}
    want = {}
    for r in listed.orderBy("row_id_a", "row_id_b").collect():
        for me, other in ((r.variant_a, r.variant_b), (r.variant_b, r.variant_a)):
            score = r.confidence if quality[me] and affected is not None else min(r.confidence, 0.5)
            if me not in want or score >= want[me][0]:
                want[me] = (score, other, r.phase)
    got = {
        r.variant_id: (r.compound.score, r.compound.partner, r.compound.phase)
        for r in P.compound_best(t).where("compound is not null").collect()
    }
    assert got == want and want


def test_hot_gene_is_linear(spark):
    """One gene with 3000 variants: no pair list is needed for the evidence."""
    rows = [variant(i, "0/1", "0/1" if i % 2 else "0/0", "0/0" if i % 2 else "0/1") for i in range(3000)]
    t = trio(spark, rows)
    assert P.partner_classes(t).select(F.size("classes")).first()[0] <= 36
    assert P.compound_best(t).where("compound.score = 0.95").count() == 3000


@pytest.mark.parametrize("n, pairs", [(1, 0), (2, 1), (447, 99_681), (632, 199_396)])
def test_pair_work(spark, n, pairs):
    df = spark.createDataFrame([variant(i, "0/1") for i in range(n)], SCHEMA)
    assert int(P.pair_work(df).first().pairs) == pairs


def test_pair_list_of_a_hot_gene_is_blocked(spark):
    """5 000 variants of one gene: every pair once, and no key holds more than two blocks."""
    df = spark.range(5000).select(
        F.lit("r").alias("run_id"), F.concat(F.lit("v"), "id").alias("variant_id"), F.col("id").alias("row_id"),
        F.lit("G").alias("gene"), F.lit("1").alias("chromosome"), F.lit("0/1").alias("genotype"),
    )
    pairs = P.het_pairs(df, [])
    ids = pairs.agg(
        F.count(F.lit(1)), F.sum(F.col("row_id_a") * F.lit(5000) + F.col("row_id_b")), F.count_if(F.col("row_id_a") >= F.col("row_id_b"))
    ).first()
    n = 5000
    want = sum(a * n * (n - 1 - a) + (n - 1 - a) * (n + a) // 2 for a in range(n))
    assert tuple(ids) == (n * (n - 1) // 2, want, 0)


def test_blocks_give_the_same_pairs(spark):
    df = spark.createDataFrame([variant(i, "0/1") for i in range(40)], SCHEMA)
    plain, cut = (
        {(r.row_id_a, r.row_id_b) for r in P.het_pairs(df, [], block_rows=b).collect()} for b in (500, 7)
    )
    assert plain == cut and len(plain) == 40 * 39 // 2
