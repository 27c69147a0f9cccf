"""Operators that stand on several jobs: star joins, fixpoints, shards, exports."""

import hashlib
import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_inheritance import trio, variant
from tests.test_relational import plan_rows
from varloom.operators import assembly as AS
from varloom.operators import coverage as C
from varloom.operators import evaluation as EV
from varloom.operators import ontology as O
from varloom.operators import pairs as P
from varloom.operators import quality as Q
from varloom.operators import selection as SEL
from varloom.plans import branch_plan as BP
from varloom.plans import case_analysis as CA
from varloom.session import DataCheckError
from varloom.sinks import writers as W

# --- pairs from anchors ------------------------------------------------------


def anchor_case(spark, n, genes, seed):
    rng = random.Random(seed)
    calls = ["0/1", "0|1", "1|0", "1/1", "0/0"]
    rows = [
        variant(k, rng.choice(calls), rng.choice(["0/1", "0/0", "./."]), rng.choice(["0/1", "0/0", "./."]), gene=rng.choice(genes))
        for k in range(n)
    ]
    mapping = spark.createDataFrame([("r", f"v{k:03d}", f"a{k // 2:04d}") for k in range(n)], "run_id string, variant_id string, allele_id string")
    anchors = spark.createDataFrame(
        [("r", f"a{k:04d}", 1) for k in rng.sample(range(n // 2), min(n // 2, 40))], "run_id string, allele_id string, base_rank long"
    )
    return trio(spark, rows), mapping, SEL.anchors(anchors)


@pytest.mark.parametrize("n, genes, block", [(60, ["G1", "G2", "unknown", None, "g1"], 500), (120, ["G1"], 7)])
def test_anchor_pairs_equal_the_pair_list(spark, n, genes, block):
    t, mapping, anchors = anchor_case(spark, n, genes, n)
    listed = SEL.incident_pairs(anchors, P.pair_phase(t), mapping)
    star = SEL.witnesses(SEL.anchor_pairs(t, anchors, mapping, block))
    assert Q.row_difference(listed, star.select(*listed.columns)).count() == 0 and listed.count() > 20


def test_anchor_pairs_of_a_hot_gene(spark):
    t, mapping, anchors = anchor_case(spark, 5_000, ["HOT"], 9)
    star = SEL.anchor_pairs(t, anchors, mapping)
    hot = t.where("_p_het and genotype in ('0/1', '0|1', '1|0')").join(mapping, ["run_id", "variant_id"])
    held = hot.join(anchors, ["run_id", "allele_id"], "left_semi").count()
    both = hot.join(anchors, ["run_id", "allele_id"], "left_semi").groupBy("allele_id").count().where("count = 2").count()
    assert star.count() == held * (hot.count() - 1) - both  # the two rows of one allele meet once
    assert star.where("variant_a = variant_b").count() == 0


# --- submission --------------------------------------------------------------


def test_draft_and_audit_disagree_when_a_cell_is_altered(spark, tmp_path):
    hypotheses = spark.createDataFrame(
        [("r", 1, "a", "b", "x", "unknown", "G"), ("r", 2, "c", None, "y", None, None)],
        "run_id string, submission_rank int, first string, second string, reason string, phase_status string, gene string",
    )
    alleles = spark.createDataFrame(
        [("r", "a", "1", 10, "A", "C"), ("r", "b", "1", 20, "G", "T"), ("r", "c", "X", 5, "A", "G")],
        "run_id string, allele_id string, chromosome string, position long, reference string, alternate string",
    )
    roles = spark.createDataFrame([("r", "P")], "run_id string, proband_id string")
    W.write_submission(SEL.submission_rows(hypotheses, alleles, roles), str(tmp_path / "s"))
    draft, audit = W.read_submission(spark, str(tmp_path / "s")), SEL.submission_audit(hypotheses, alleles)
    rows = {r.submission_rank: r for r in SEL.export_submission(draft, audit).collect()}
    assert (rows[1].chrom_1, rows[1].chrom_2, rows[1].pos_2, rows[2].chrom_1, rows[2].chrom_2) == ("chr1", "chr1", "20", "chrX", "")
    for column, value in (("pos_2", "21"), ("alt_1", "T"), ("epcr", "0.2"), ("chrom_2", "")):
        altered = draft.withColumn(column, F.when(F.col("submission_rank") == 1, value).otherwise(F.col(column)))
        with pytest.raises(DataCheckError):
            SEL.export_submission(altered, audit)
    with pytest.raises(DataCheckError):  # an endpoint without a saved allele
        SEL.export_submission(draft, SEL.submission_audit(hypotheses, alleles.where("allele_id <> 'b'")))


# --- fixpoints ---------------------------------------------------------------


def test_ancestors_of_deep_and_cyclic_graphs(spark):
    rng = random.Random(2)
    edges = {(f"n{k}", f"n{k + 1}") for k in range(25)} | {(f"n{rng.randrange(25)}", f"m{rng.randrange(9)}") for _ in range(20)}
    edges |= {("m1", "m2"), ("m2", "m3"), ("m3", "m1"), ("self", "self")}
    reach = {a: {y for x, y in edges if x == a} for a, _ in edges}
    while True:
        grown = {a: b | {z for y in b for z in reach.get(y, ())} for a, b in reach.items()}
        if grown == reach:
            break
        reach = grown
    got = O.proper_ancestors(spark.createDataFrame(sorted(edges), "term string, ancestor string"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(a, b) for a, bs in reach.items() for b in bs}


def test_ancestors_of_no_edges(spark):
    assert O.proper_ancestors(spark.createDataFrame([], "term string, ancestor string")).count() == 0


def test_ancestors_do_not_read_the_known_pairs_in_every_round(spark, monkeypatch):
    """Six rounds of a chain with shortcuts: paths end by themselves, no anti-join with all pairs."""
    edges = [(str(i), str(i + k)) for i in range(7) for k in (1, 2) if i + k < 7]
    frame = spark.createDataFrame(edges, "term string, ancestor string")
    kinds, join = [], type(frame).join

    def noted(self, other, on=None, how=None):
        kinds.append(how)
        return join(self, other, on, how)

    monkeypatch.setattr(type(frame), "join", noted)
    got = O.proper_ancestors(frame).collect()
    assert sorted(map(tuple, got)) == sorted((str(i), str(j)) for i in range(7) for j in range(i + 1, 7))
    assert "left_anti" not in kinds and kinds


# --- scores without a term ---------------------------------------------------


def test_score_without_a_term_equals_a_second_scoring(spark):
    rng = random.Random(6)
    terms = [(f"HP:{k:07d}", "x", [f"HP:{k // 2:07d}"] if k > 1 else [], False, None) for k in range(1, 64)]
    frame = spark.createDataFrame(terms, "hpo_id string, label string, parents array<string>, obsolete boolean, replaced_by string")
    assoc = spark.createDataFrame([(f"G{rng.randrange(12)}", f"HP:{rng.randrange(1, 64):07d}", None) for _ in range(60)], "gene string, hpo_id string, qualifier string")
    closed = O.closure(frame)
    ancestors = O.informative_ancestors(closed, O.information_content(assoc, closed))
    patient = [(r, p, f"HP:{rng.randrange(1, 64):07d}") for r in ("r1", "r2", "r3") for p in range(4)] + [("one", 0, "HP:0000007")]
    patient += [("twice", 0, "HP:0000009"), ("twice", 1, "HP:0000005"), ("twice", 2, "HP:0000009")]
    given = spark.createDataFrame(patient, "run_id string, position long, hpo_id string")
    genes = spark.createDataFrame([(r, f"g{g}") for r in ("r1", "r2", "r3", "one", "twice") for g in range(13)], "run_id string, gene string")
    dropped = CA.last_terms(given)
    assert {r.run_id for r in dropped.collect()} <= {"r1", "r2", "r3"}
    both = O.phenotype_scores(given, genes, assoc, ancestors, dropped)
    rest = given.join(dropped, ["run_id", "hpo_id"], "left_anti")
    full, partial = (O.phenotype_scores(x, genes, assoc, ancestors).select("run_id", "gene", "score") for x in (given, rest))
    assert Q.row_difference(both.select("run_id", "gene", "score"), full).count() == 0
    assert Q.row_difference(both.select("run_id", "gene", F.col("score_without").alias("score")), partial).count() == 0


def test_ranks_of_few_targets(spark):
    rng = random.Random(1)
    rows = [(f"r{k % 3}", f"v{k:03d}", rng.randrange(5) / 4, rng.randrange(5) / 4) for k in range(90)]
    scored = spark.createDataFrame(rows, "run_id string, variant_id string, a double, b double")
    got = CA.ranks_of(scored, scored.where("variant_id in ('v003', 'v004', 'v007')"), ["a", "b"]).collect()
    assert len(got) == 3
    for r in got:
        run = [x for x in rows if x[0] == r.run_id]
        for at, rank in ((2, r.a_rank), (3, r.b_rank)):
            assert [x[1] for x in sorted(run, key=lambda x: (-x[at], x[1]))].index(r.variant_id) + 1 == rank


# --- bootstrap ---------------------------------------------------------------


def test_bootstrap_draws_are_reduced_before_they_are_shuffled(spark):
    cases = spark.range(500).select(F.col("id").cast("string").alias("case_id"), (F.col("id") % 7 + 1).cast("int").alias("r"))
    made = EV.bootstrap_metrics(cases, "r", 17, 100)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert made.count() == 100
    with pytest.raises(ValueError):
        EV.bootstrap_metrics(cases, "r", 17, 20_000)


# --- lineage -----------------------------------------------------------------


def test_lineage_follows_the_executed_steps(spark):
    steps = [
        BP.Step("copy", "all", "conservative"),
        BP.Step("filter_frequency", "conservative", "rare", {"maximum": 0.01}),
        BP.Step("filter_gene", "rare", "none", {"genes": ["X"]}),  # too few rows: rejected
        BP.Step("filter_gene", "none", "deeper", {"genes": ["G1"]}),  # no such branch
        BP.Step("filter_gene", "rare", "g1", {"genes": ["G1"]}),
        BP.Step("evidence_branches", "all"),
        BP.Step("merge", target="both", parameters={"branches": ["rare", "conservative"]}),
        BP.Step("stop", "both"),
    ]
    rows = BP.run_plan(plan_rows(spark), steps, BP.CASE_LIMITS)["lineage"].collect()
    got = {r.branch: (r.stage, r.parent, r.operations) for r in rows}
    assert got == {
        "all": (0, None, []), "conservative": (1, "all", ["rescue_copy"]), "rare": (2, "conservative", ["rescue_copy", "af<=0.01"]),
        "g1": (3, "rare", ["rescue_copy", "af<=0.01", "gene_in:G1"]),
        "phenotype-priority": (1, "all", ["evidence:phenotype-priority"]), "inheritance-priority": (1, "all", ["evidence:inheritance-priority"]),
        "novel-gene-rescue": (1, "all", ["evidence:novel-gene-rescue"]), "both": (4, None, ["union:rare,conservative"]),
    }


def test_lineage_of_a_plan_that_makes_nothing(spark):
    rows = BP.run_plan(plan_rows(spark), [BP.Step("inspect_statistics"), BP.Step("stop", "all")])["lineage"].collect()
    assert [(r.run_id, r.branch, r.stage, r.operations) for r in rows] == [("r", "all", 0, [])]


def test_gene_scores_save_only_ancestors_that_a_patient_shares(spark, monkeypatch):
    """Ancestors of the genes' terms that no patient term has can add nothing and are not saved."""
    ancestors = spark.createDataFrame(
        [("p", "p", 0.9), ("p", "top", 0.2), ("g", "g", 0.8), ("g", "top", 0.2), ("h", "h", 0.7)], "term string, ancestor string, sim double"
    )
    patient = spark.createDataFrame([("r", "p")], "run_id string, hpo_id string")
    genes = spark.createDataFrame([("r", "g1"), ("r", "G2"), ("r", "none")], "run_id string, gene string")
    associations = spark.createDataFrame([("G1", "g"), ("g1", "p"), ("G2", "h")], "gene string, hpo_id string")
    saved, plain = {}, O.written
    monkeypatch.setattr(O, "written", lambda df, name: saved.setdefault(name, plain(df, name)))
    got = {r.gene: (r.score, r.matched_terms) for r in O.phenotype_scores(patient, genes, associations, ancestors).collect()}
    # G1: p meets p (0.9), and of its terms p gives 0.9 and g gives 0.2
    assert got == {"G1": (round((0.9 + 0.9 + 0.2) / 3, 6), ["p"]), "G2": (0.0, []), "NONE": (0.0, [])}
    assert {(r.term, r.ancestor) for r in saved["reach"][0].collect()} == {("p", "p"), ("p", "top"), ("g", "top")}
    sets = {r.gene: r.matched_terms for r in O.matched_terms(patient, genes, associations).collect()}
    assert sets == {"G1": ["p"], "G2": [], "NONE": []}


# --- shards ------------------------------------------------------------------


def shard_case(spark):
    lines = [("s" if k < 1_700 else "t", k if k < 1_700 else k - 1_699, f"line {k}") for k in range(1, 2_000)]
    records = spark.createDataFrame(lines, "source string, ordinal long, line string")
    bounds = [(s, n + 1, n * 500 + 1, min((n + 1) * 500, last)) for s, last in (("s", 1_699), ("t", 300)) for n in range(-(-last // 500))]
    return records, spark.createDataFrame(bounds, "source string, shard long, first_row long, last_row long"), lines


def test_shards_have_headers_and_receipts(spark, tmp_path):
    records, bounds, lines = shard_case(spark)
    heads = spark.createDataFrame([("s", 0, "#one"), ("s", 1, "#two")], "source string, line_no long, line string")
    path = str(tmp_path / "w")
    receipts = {(r.source, r.shard): r for r in C.write_shards(records, bounds, 1, 4, path, heads).collect()}
    assert set(receipts) == {("s", 1), ("s", 2), ("s", 3), ("s", 4), ("t", 1)}
    for (source, shard), r in receipts.items():
        text = "#one\n#two\n" if source == "s" else ""
        text += "".join(f"{x}\n" for s, o, x in lines if s == source and r.first_row <= o <= r.last_row)
        assert (r.bytes, r.sha256, r.header_lines) == (len(text), hashlib.sha256(text.encode()).hexdigest(), 2 * (source == "s"))
        assert (tmp_path / "w" / "shards" / r.file).read_text() == text
    assert C.shard_violations(spark, path, bounds, 1, 4).count() == 0
    # a lost receipt, a changed file and a lost file
    left = [r for k, r in receipts.items() if k != ("s", 2)]
    shutil.rmtree(tmp_path / "w" / "receipts")
    spark.createDataFrame(left).write.parquet(f"{path}/receipts")
    for name in (receipts["s", 3].file, receipts["t", 1].file):
        file = Path(path, "shards", name)
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
        if "source=t" in name:
            file.unlink()
        else:
            file.write_text("other\n")
    got = {(r.source, r.shard): r.reason for r in C.shard_violations(spark, path, bounds, 1, 4).collect()}
    assert got == {("s", 2): "receipt_missing", ("s", 3): "file_differs", ("t", 1): "file_missing"}


def test_shard_files_are_written_and_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The driver moves and lists no shard file, and an odd source name stays one folder."""
    records, bounds, lines = shard_case(spark)
    odd = lambda df: df.withColumn("source", F.when(F.col("source") == "s", "a/b=c %").otherwise(F.col("source")))
    records, bounds, path = odd(records), odd(bounds), str(tmp_path / "w")
    monkeypatch.setattr(C, "FOLDER_SHARDS", 2)
    receipts = {(r.source, r.shard): r for r in C.write_shards(records, bounds, 1, 4, path).collect()}
    assert sorted(receipts) == [("a/b=c %", n) for n in (1, 2, 3, 4)] + [("t", 1)]
    files = [f for f in (tmp_path / "w" / "shards").rglob("*") if f.is_file()]
    assert len(files) == 5  # a file a shard and nothing beside it
    assert len({f.parent for f in files}) == 4
    assert Path(path, "shards", receipts["a/b=c %", 2].file).read_text() == "".join(f"{x}\n" for s, o, x in lines if s == "s" and 501 <= o <= 1_000)
    assert C.shard_violations(spark, path, bounds, 1, 4).count() == 0
    Path(files[0].parent, "shard=9.txt").write_text("extra\n")
    assert [r.reason for r in C.shard_violations(spark, path, bounds, 1, 4).collect()] == ["not_planned"]
    jobs = C.shard_files(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in jobs and "BatchScan" not in jobs


def test_folder_of_shards_is_assembled_by_one_scan(spark, tmp_path):
    records, bounds, _ = shard_case(spark)
    tables = C.records_of_shards(records, bounds, 1, 4)
    tables.repartition("source", "shard").write.partitionBy("source", "shard").parquet(str(tmp_path / "t"))
    schema = tables.select("ordinal", "line", "source", "shard").schema
    whole = AS.assemble_folder(spark, str(tmp_path / "t"), bounds, schema, [["source", "ordinal"]])
    assert Q.row_difference(whole.select("source", "ordinal", "line"), records).count() == 0
    assert "Union" not in whole._jdf.queryExecution().executedPlan().toString()

    def refused(receipts, directory="t"):
        with pytest.raises(DataCheckError):
            AS.assemble_folder(spark, str(tmp_path / directory), receipts, schema, [["source", "ordinal"]])

    refused(bounds.where("shard < 4"))
    refused(bounds.unionByName(bounds.where("shard = 2")))
    refused(bounds.withColumn("last_row", F.when(F.col("shard") == 1, F.lit(501).cast("long")).otherwise(F.col("last_row"))))
    tables.where("shard = 1").select("line", F.col("ordinal").cast("int").alias("ordinal"), "source", "shard").write.mode("append").partitionBy(
        "source", "shard"
    ).parquet(str(tmp_path / "t"))
    refused(bounds)


# --- preflight ---------------------------------------------------------------


def test_preflight_counts_repeated_ids_and_warns(spark):
    rows = [variant(1, "0/1"), variant(1, "0/1"), variant(1, "0/1"), variant(2, "0/1", m="./.")]
    people = spark.createDataFrame([("r", "P", "male"), ("r", "M", "female"), ("r", "F", "male")], "run_id string, id string, sex string")
    roles = spark.createDataFrame([("r", "P")], "run_id string, proband_id string")
    v = spark.createDataFrame(rows, "run_id string, row_id bigint, variant_id string, gene string, chromosome string, genotype string, calls map<string,struct<genotype:string,quality:double,alternate_fraction:double>>")
    v = v.withColumns({"position": F.lit(5), "reference": F.lit("A"), "alternate": F.lit("C"), "consequence": F.lit("x"), "transcript": F.lit("t"), "allele_frequency": F.lit(0.1)})
    (row,) = Q.preflight(v, people, roles, {"X": [(1, 2)]}).collect()
    assert (row.records, row.duplicate_variant_id, row.missing_genotypes, row.warnings) == (4, 2, 1, ["missing_calls_not_imputed"])
    assert Q.preflight_failures(Q.preflight(v, people, roles, {"X": [(1, 2)]})).first().broken == ["duplicate_variant_id"]


def test_bootstrap_draws_of_many_cases_do_not_overflow(spark):
    """Past some 6400 cases the plain product passes 64 bits; the picks must be those of exact integers."""
    n, samples = 7_000, 100
    cases = spark.range(n).select(F.col("id").alias("case_id"), (F.col("id") % 13 + 1).alias("rank"))
    got = {r.sample: r.mrr for r in EV.bootstrap_metrics(cases, "rank", 17, samples).collect()}
    for sample in (0, samples - 1):
        total = 0.0
        for j in range(n):
            x = 17 * 7919 + sample * 104_729 + j * 1_299_709
            for _ in range(3):
                x = (x * EV.LCG_A + EV.LCG_C) % EV.LCG_M
            total += 1 / ((x >> 8) % n % 13 + 1)
        assert abs(got[sample] - total / n) < 1e-9
