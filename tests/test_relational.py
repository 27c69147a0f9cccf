import math
import random

import pytest
from pyspark.sql import functions as F

from varloom import constants as K
from varloom.operators import branches as B
from varloom.operators import coverage as C
from varloom.operators import evaluation as EV
from varloom.operators import evidence as E
from varloom.operators import ontology as O
from varloom.operators import quality as Q
from varloom.operators import ranking as R
from varloom.plans import branch_plan as BP
from varloom.session import DataCheckError

TERMS = [
    ("HP:0000001", "All", [], False, None), ("HP:0000002", "a", ["HP:0000001"], False, None), ("HP:0000003", "b", ["HP:0000002", "HP:0000001"], False, None),
    ("HP:0000004", "c", ["HP:0000002"], False, None), ("HP:0000005", "old", [], True, "HP:0000004"), ("HP:0000006", "gone", [], True, None),
]
ASSOC = [("A", "HP:0000003", None), ("A", "HP:0000005", None), ("B", "HP:0000002", None), ("C", "HP:0000001", None), ("D", "HP:0000003", "NOT")]


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame(TERMS, "hpo_id string, label string, parents array<string>, obsolete boolean, replaced_by string")


@pytest.fixture(scope="module")
def associations(spark, terms):
    df = spark.createDataFrame(ASSOC, "gene string, hpo_id string, qualifier string")
    return O.resolve_associations(df, terms)


def plain_ancestors(term):
    parents = {t[0]: t[2] for t in TERMS}
    out, todo = set(), [term]
    while todo:
        x = todo.pop()
        if x not in out:
            out.add(x)
            todo += parents.get(x, [])
    return out


def test_closure(spark, terms):
    got = {(r.term, r.ancestor) for r in O.closure(terms).collect()}
    assert got == {(t[0], a) for t in TERMS for a in plain_ancestors(t[0])}


def test_scores_against_plain_form(spark, terms, associations):
    closed = O.closure(terms)
    ic = O.information_content(associations, closed)
    anc = O.informative_ancestors(closed, ic)
    patient = spark.createDataFrame([("r", "HP:0000003"), ("r", "HP:0000004"), ("q", "HP:0000002")], "run_id string, hpo_id string")
    genes = spark.createDataFrame([(r, g) for r in "rq" for g in ("a", "B", "C", "D", "none")], "run_id string, gene string")
    rows = {(r.run_id, r.gene): r for r in O.phenotype_scores(patient, genes, associations, anc).collect()}
    gene_terms = {"A": ["HP:0000003", "HP:0000004"], "B": ["HP:0000002"], "C": ["HP:0000001"]}
    below = {t[0]: {g for g, ts in gene_terms.items() if any(t[0] in plain_ancestors(x) for x in ts)} for t in TERMS}
    info = {t: -math.log((len(gs) + 1) / 4) for t, gs in below.items() if gs}
    top = max(info.values())

    def sim(a, b):
        return max((info.get(t, 0) / top for t in plain_ancestors(a) & plain_ancestors(b)), default=0)

    for run, ps in (("r", ["HP:0000003", "HP:0000004"]), ("q", ["HP:0000002"])):
        for gene, ts in gene_terms.items():
            want = (sum(max(sim(p, t) for t in ts) for p in ps) + sum(max(sim(p, t) for p in ps) for t in ts)) / (len(ps) + len(ts))
            assert rows[(run, gene)].score == pytest.approx(want, abs=1e-6)
        assert rows[(run, "NONE")].score == 0 and not rows[(run, "NONE")].known and not rows[(run, "D")].known
    assert rows[("r", "A")].matched_terms == ["HP:0000003", "HP:0000004"]


def test_components(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randint(0, 200)}", f"n{rng.randint(0, 200)}") for _ in range(120)] + [("hub", f"n{i}") for i in range(60)]
    got = {r.node: r.component for r in O.components(spark.createDataFrame(edges, "left string, right string")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    groups = {}
    for node in got:
        groups.setdefault(find(node), set()).add(node)
    assert got == {n: min(g) for g in groups.values() for n in g}


def test_retrieval_golden(spark):
    df = spark.createDataFrame([(1,), (2,), (10,), (None,)], "r int")
    row = EV.retrieval_metrics(df, "r").first()
    assert (row.mrr, row.top_1_recall, row.top_5_recall, row.top_10_recall) == (0.4, 0.25, 0.5, 0.75)


def test_two_allele_case_takes_the_worse_rank(spark):
    truth = spark.createDataFrame(
        [("c", "r", "h", "E1", None, [(1, 1), (2, 1)]), ("d", None, "i", "E2", "no run", []), ("e", "r", "j", "E2", None, [(9, 1)])],
        "case_id string, run_id string, source_sha256 string, expected_gene_id string, unavailable_reason string, alleles array<struct<source_row:bigint,source_alt:int>>",
    )
    alleles = spark.createDataFrame([("r", f"a{i}", i, 1, "included") for i in (1, 2, 3)], "run_id string, allele_id string, source_row bigint, source_alt int, disposition string")
    mapping = spark.createDataFrame(
        [("r", "v1", "a1", "E1"), ("r", "v2", "a2", "E1"), ("r", "v3", "a3", "E2"), ("r", "v4", "a1", "E3")],
        "run_id string, variant_id string, allele_id string, gene_id string",
    )
    ranks = spark.createDataFrame([("r", "v3", 1), ("r", "v4", 2), ("r", "v1", 3), ("r", "v2", 4)], "run_id string, variant_id string, rank bigint")
    rows = {r.case_id: r for r in EV.evaluate_cases(truth, alleles, mapping, ranks, spark.createDataFrame([("r",)], "run_id string")).collect()}
    c = rows["c"]
    assert (c.gene_rank, c.allele_rank, c.allele_gene_rank) == (3, 3, 4)
    assert rows["d"].status == "no run" and rows["d"].gene_rank is None
    assert rows["e"].gene_rank == 1 and rows["e"].allele_rank is None


EV_SCHEMA = "run_id string, variant_id string, gene string, method string, data_version string, score double, known boolean, seq bigint, payload string"


def events(seed, n):
    rng = random.Random(seed)
    return [("r", f"v{rng.randint(0, 20)}", "G", rng.choice(["a", "b"]), "1", rng.choice([0.1, 0.5, 0.9, None]), True, i, f"p{i}") for i in range(n)]


def sequential(rows):
    best = {}
    for r in rows:
        key = r[:5]
        if key not in best or (r[5] is not None and (best[key][5] is None or r[5] >= best[key][5])):
            best[key] = r
    return {k: v[5] for k, v in best.items()}, {k: v[8] for k, v in best.items() if v[5] is not None}


def test_reduce_equals_sequential_upserts(spark):
    rows = events(4, 400)
    reduced = E.reduce_evidence(spark.createDataFrame(rows, EV_SCHEMA).repartition(5)).collect()
    scores, payloads = sequential(rows)
    assert {tuple(r)[:5]: r.score for r in reduced} == scores
    assert {tuple(r)[:5]: r.payload for r in reduced if r.score is not None} == payloads


def test_mixed_versions_are_refused(spark):
    rows = events(4, 5) + [("r", "v1", "G", "a", "2", 0.1, True, 9, "p")]
    with pytest.raises(DataCheckError):
        E.reduce_evidence(spark.createDataFrame(rows + [("r", "v1", "G", "a", "1", 0.1, True, 9, "p")], EV_SCHEMA))


def plan_rows(spark):
    rows = [
        ("r", f"v{i}", f"G{i % 3}", 50.0, None if i % 5 == 0 else i / 1000, "stop_gained" if i % 4 == 0 else "intron_variant", None, i / 30, i % 2 / 1.0, i % 3 > 0)
        for i in range(30)
    ]
    return spark.createDataFrame(
        rows,
        "run_id string, variant_id string, gene string, quality double, allele_frequency double, consequence string, clinvar_classification string, "
        "phenotype_score double, inheritance_score double, known boolean",
    )


def test_plan_rules(spark):
    steps = [
        BP.Step("filter_frequency", "all", "rare", {"maximum": 0.01}),
        BP.Step("filter_frequency", "all", "rare2", {"maximum": 0.01}),
        BP.Step("filter_gene", "rare", "none", {"genes": ["X"]}),
        BP.Step("filter_gene", "none", "deeper", {"genes": ["G1"]}),
        BP.Step("copy", "all", "conservative"),
        BP.Step("merge", target="ensemble", parameters={"branches": ["rare", "conservative"]}),
        BP.Step("stop", "ensemble"),
    ]
    out = BP.run_plan(plan_rows(spark), steps, BP.Limits(floor=5))
    audit = [(r.action, r.outcome, r.after_count) for r in out["audit"].orderBy("step").collect()]
    assert audit == [
        ("filter_frequency", "executed", 14), ("filter_frequency", "rejected", None), ("filter_gene", "rejected", 0),
        ("filter_gene", "error", None), ("copy", "executed", 30), ("merge", "executed", 30), ("stop", "stopped", 30),
    ]
    names = {r.branch for r in BP.membership(out["features"]).collect()}
    assert names == {"all", "rare", "conservative", "ensemble"}


def test_default_plan_equals_branch_operators(spark):
    f = plan_rows(spark)
    out = BP.membership(BP.run_plan(f, limits=BP.CASE_LIMITS)["features"])
    m = B.seed(f)
    m = B.copy_branch(m, "all", "conservative")
    from varloom.operators import filters as D

    m = B.filter_branch(m, f, "conservative", "conservative_rare", D.rare(0.01))
    m = B.copy_branch(m, "all", "pathogenicity")
    m = B.filter_branch(m, f, "pathogenicity", "pathogenicity-priority", D.consequence_in(list(K.HIGH_IMPACT_CONSEQUENCES)))
    for name, flag in B.evidence_flags().items():
        m = B.filter_branch(m, f, "all", name, flag)
    m = B.union_branches(m, ["conservative_rare", "phenotype-priority", "inheritance-priority", "pathogenicity-priority", "novel-gene-rescue"], "ensemble")
    assert Q.row_difference(out, m).count() == 0


def test_contexts():
    names = [c["context"] for c in R.contexts()]
    assert len(names) == len(set(names)) == 28
    with pytest.raises(ValueError):
        R.check_weights({"quality": 1.0})


def plain_segments(records, limit, overrides):
    out, current, shards = [], None, 0
    for row, chrom, disp in records:
        eligible = disp == C.ELIGIBLE
        cap = overrides.get(shards, limit)
        if current is None or [chrom, disp] != current[2:4] or (eligible and row - current[0] >= cap):
            if eligible:
                shards += 1
            current = [row, row, chrom, disp, shards if eligible else None]
            out.append(current)
        current[1] = row
    return [tuple(x) for x in out]


@pytest.mark.parametrize("overrides", [{}, {2: 3, 5: 1}])
def test_segments(spark, overrides):
    rng = random.Random(8)
    records, chrom, disp = [], "1", C.ELIGIBLE
    for row in range(1, 260):
        if rng.random() < 0.06:
            chrom = rng.choice("123")
        if rng.random() < 0.06:
            disp = rng.choice([C.ELIGIBLE, C.ELIGIBLE, "nonsequence_allele_pending"])
        records.append((row, chrom, disp))
    df = spark.createDataFrame([("s", r, c, d, 1, f"x{r}") for r, c, d in records], "source string, ordinal bigint, chromosome string, disposition string, n_alt int, line string")
    got = C.plan_segments(df.repartition(5), 10, {("s", k): v for k, v in overrides.items()})
    rows = sorted((r.first_row, r.last_row, r.chromosome, r.disposition, r.shard) for r in got.collect())
    assert rows == plain_segments(records, 10, overrides)
    assert Q.interval_breaks(got, ["source"]).count() == 0
    import hashlib

    first = min(got.collect(), key=lambda r: r.first_row)
    text = "".join(f"x{r}\n" for r in range(first.first_row, first.last_row + 1))
    assert first.records_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_even_sample(spark):
    for n, k in ((1, 3), (7, 3), (100, 7), (5, 9)):
        df = spark.range(1, n + 1).select(F.lit("s").alias("source"), F.lit("1").alias("chromosome"), F.col("id").alias("ordinal"))
        got = {r.ordinal - 1 for r in C.even_sample(df, k).collect()}
        m = min(n, k)
        assert got == {(2 * i + 1) * n // (2 * m) for i in range(m)}


def test_pedigree_rules(spark):
    schema = "run_id string, id string, sex string, affected boolean, mother_id string, father_id string"
    people = spark.createDataFrame([("r", "P", "male", True, "M", "F"), ("r", "M", "female", False, "P", None), ("r", "F", "male", False, None, "X")], schema)
    roles = spark.createDataFrame([("r", "P", "M", "F")], "run_id string, proband_id string, mother_id string, father_id string")
    assert {r.reason for r in Q.pedigree_violations(people, roles).collect()} == {"unknown_parent"}
    assert {r.id for r in Q.pedigree_cycles(people, roles).collect()} == {"P", "M"}


def test_pedigree_of_more_than_a_thousand_people(spark):
    n = F.when(F.col("id") <= K.MAX_INDIVIDUALS, "full").otherwise("large")
    people = spark.range(1, 2 * K.MAX_INDIVIDUALS + 2).select(
        n.alias("run_id"), F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("mother_id"), F.lit(None).cast("string").alias("father_id")
    )
    roles = spark.createDataFrame([("full", "1", "2", "3"), ("large", "1001", "1002", "1003")], "run_id string, proband_id string, mother_id string, father_id string")
    assert [tuple(r) for r in Q.pedigree_violations(people, roles).collect()] == [("large", "pedigree_too_large")]


def test_critic_facts_parse_a_payload_once(spark):
    """Repeated, missing and exclusive-only rows; provenance of a payload is read by one parse."""
    def row(v, method, score, run="r"):
        return ("r", v, "A", method, "d", score, f'{{"x": 1, "provenance": {{"run_id": "{run}", "data_version": "d"}}}}')

    rows = [row("a", m, 0.9) for m in K.SINGLE_MODELS] + [row("b", "de_novo", 0.9), row("b", "de_novo", 0.9), row("b", "x_linked", 0.1, "other")]
    rows += [("r", "", "A", K.PHENOTYPE_METHOD, "d", 0.5, None)]
    evidence = spark.createDataFrame(rows, "run_id string, variant_id string, gene string, method string, data_version string, score double, payload string")
    ranking = spark.createDataFrame([("r", K.BASE_MODE, v, "a", i) for i, v in enumerate("abc", 1)], "run_id string, context string, variant_id string, gene string, rank long")
    rescue = spark.createDataFrame([("r", "a", "novel-gene-rescue", True), ("r", "z", "novel-gene-rescue", True)], "run_id string, variant_id string, branch string, active boolean")
    facts = EV.critic_facts(ranking, evidence, rescue)
    got = facts.first().asDict()
    assert got == {"run_id": "r", "ranked": 3, "without_phenotype": 0, "without_inheritance": 1, "incomplete_models": 2, "provenance_mismatches": 2, "rescue_lost": 1, "competing_models": 2}
    assert "get_json_object" not in facts._jdf.queryExecution().toString()
