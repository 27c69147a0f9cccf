import duckdb
import pytest

import __spark_entry__ as entry
from check import canonical
from pyspark.sql import functions as F
from varloom.operators import annotate as A
from varloom.operators import ordering
from varloom.operators import ranking as R
from varloom.plans import case_analysis as CA
from varloom.plans import corpus as CO
from varloom.operators import selection as SEL
from workload import catalog
from workload import queries_domain as QD
from workload import queries_relational as QR
from workload import shared as S
from workload import tables as T
from workload import text as X
from workload.tables import SOURCE_TABLES

SF = "/root/testdata/sf0.001"
NAMES = ["c07_genotype_predicates", "c20_ranking_features", "d02_rarity_filter", "g06_evidence_merge", "h05_source_ordinal", "j01_multiset_difference", "k10_pair_endpoint_evidence"]


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in SOURCE_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, engine, name):
    got = canonical(entry.queries()[name](spark, SF).toPandas())
    want = canonical(engine.sql(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)


def same_as_sql(spark, folder, tables, names):
    """Queries over a few rows written to ``folder``, against their SQL."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.sql(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    for name in names:
        got = canonical(entry.queries()[name](spark, str(folder)).toPandas())
        want = canonical(con.sql(entry.oracle_sql()[name]).df())
        assert len(want) and got.equals(want), name


def test_order_zero_is_a_valid_row_of_a_small_file(spark, tmp_path):
    orders = "SELECT CAST(k AS BIGINT) AS o_orderkey, CAST(k % 2 AS BIGINT) AS o_custkey FROM (VALUES (0), (10), (52), (61), (70), (101)) t(k)"
    same_as_sql(spark, tmp_path, {"orders": orders}, ["d08_submission_contract"])


def test_first_row_of_order_zero_is_a_case(spark, tmp_path):
    orders = "SELECT CAST(k AS BIGINT) AS o_orderkey FROM range(0, 6) t(k)"
    lines = "SELECT o AS l_orderkey, CAST(n AS INTEGER) AS l_linenumber, o * 5 + 10 AS l_partkey, CAST(20 + n AS DOUBLE) AS l_quantity FROM range(0, 6) a(o), range(1, 5) b(n)"
    same_as_sql(spark, tmp_path, {"orders": orders, "lineitem": lines}, ["k15_case_evaluation", "k15_case_metrics"])


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(catalog.QUERIES) - set(catalog.ORACLES) <= {"k17_hypothesis_selection", "k17_selection_audit"}


def test_corpus_evidence_saves_no_features(spark, monkeypatch):
    """The evidence of a corpus needs neither its ranking features nor its branches."""
    def planned(*_, **__):
        raise AssertionError("a plan was run")

    monkeypatch.setattr("varloom.plans.branch_plan.run_plan", planned)
    rows = catalog.QUERIES["k20_corpus_evidence"](spark, SF)
    assert rows.select("method").distinct().count() == 6


def test_selection_makes_facts_of_endpoints_alone(spark, monkeypatch):
    """Neither the evidence of the cohort nor its ontology is made for the few alleles that a scan can meet."""
    made, facts, once = [], [], T.once
    monkeypatch.setattr(T, "once", lambda spark, sf, name, build: made.append(name) or once(spark, sf, name, build))
    plain = SEL.source_candidates
    monkeypatch.setattr(SEL, "source_candidates", lambda *a: facts.append((a[0].count(), a[2].count())) or plain(*a))
    anchors, incident, candidates = QD.selection_inputs(spark, SF)
    assert not {"model_evidence", "gene_evidence", "closure", "ancestors"} & set(made)
    ends = SEL.endpoints(anchors, incident)
    assert candidates.count() == ends.count()
    assert candidates.join(ends, ["run_id", "allele_id"], "left_anti").count() == 0
    assert facts[0][0] == facts[0][1] < T.variants(spark, SF).count()


def test_term_sets_need_no_graph(spark, monkeypatch):
    made, once = [], T.once
    monkeypatch.setattr(T, "once", lambda spark, sf, name, build: made.append(name) or once(spark, sf, name, build))
    assert catalog.QUERIES["j04_term_set_algebra"](spark, SF).count()
    assert made and not {"closure", "ancestors"} & set(made)


@pytest.mark.parametrize(
    ("name", "unused"),
    [("g09_model_summary", "gene_evidence"), ("g10_competing_models", "gene_evidence"), ("i05_ordered_evidence_read", "gene_evidence"), ("i01_top_genes", "model_evidence")],
)
def test_queries_of_one_kind_of_evidence_make_no_other(spark, monkeypatch, name, unused):
    made, once = [], T.once
    monkeypatch.setattr(T, "once", lambda spark, sf, n, build: made.append(n) or once(spark, sf, n, build))
    assert catalog.QUERIES[name](spark, SF).count()
    assert made and unused not in made and "evidence" not in made


def test_evidence_of_few_variants_is_that_of_the_cohort(spark):
    """Evidence of some variants: the same rows as in the evidence of all, partners included, from rows of their genes."""
    v, pedigree, scores = T.variants(spark, SF), S.pedigree(spark, SF), S.gene_scores(spark, SF)
    wanted = v.where("row_id % 97 = 1 or gene is null and row_id % 50 = 2").select("run_id", "variant_id")
    genes = v.join(wanted, ["run_id", "variant_id"]).where("gene is not null").select("run_id", F.upper("gene").alias("gene")).distinct()
    whole = CA.long_evidence(v, pedigree, scores)
    models = whole.where("variant_id <> ''").join(wanted, ["run_id", "variant_id"], "left_semi")
    held = whole.where("variant_id = ''").join(genes, ["run_id", "gene"], "left_semi")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    columns = ["run_id", "variant_id", "gene", "method", "score", "known", "payload"]
    want = sorted(map(str, models.unionByName(held.select(*models.columns)).select(*columns).collect()))
    got = CA.evidence_of(v, pedigree, scores, wanted)
    assert sorted(map(str, got.select(*columns).mapInArrow(count, got.select(*columns).schema).collect())) == want
    assert len(want) == seen.value < whole.count() / 10


def test_report_rows_rank_and_judge_no_whole_cohort(spark, engine, monkeypatch):
    """The report needs neither all ranks nor the saved evidence of all variants."""
    for place, name in ((QD, "ranking"), (QR, "evidence"), (QR, "model_evidence")):
        monkeypatch.setattr(place, name, lambda *a: pytest.fail("whole cohort"))
    got = canonical(QD.report_rows(spark, SF).toPandas())
    assert got.equals(canonical(engine.sql(entry.oracle_sql()["i03_report_rows"]).df()))


def test_ranked_page_ranks_no_whole_cohort(spark, monkeypatch):
    """A page holds the first rows of the full ranks, without placing all of them."""
    want = sorted(map(tuple, QD.ranking(spark, SF).where(f"context = '{QD.K.BASE_MODE}' and rank <= 100").select("run_id", "variant_id", "score", "rank").collect()))
    monkeypatch.setattr(QD, "ranking", lambda *a: pytest.fail("all ranks"))
    assert want and sorted(map(tuple, QD.ranked_page(spark, SF).collect())) == want


def test_ranks_are_saved_once(spark, monkeypatch):
    """Neither the planned features nor the ranks are written again after the step that makes them."""
    saved, once = set(), T.once
    monkeypatch.setattr(T, "once", lambda s, sf, name, build: saved.add(name) or once(s, sf, name, build))
    assert QD.deterministic_rank(spark, SF).count()
    assert not saved & {"planned", "ranking_default"}


def test_score_evidence_is_the_evidence_without_payload(spark):
    """Same variants, genes, models and scores as the saved evidence."""
    inputs = T.variants(spark, SF), S.pedigree(spark, SF), S.gene_scores(spark, SF)
    rows = CA.score_evidence(*inputs)
    want = CA.long_evidence(*inputs).select(*rows.columns)
    assert rows.count() == want.count() and rows.exceptAll(want).count() == 0
    assert "payload" not in rows.columns


def no_payload(monkeypatch):
    """Saved evidence may not be asked for."""
    for name in ("evidence", "model_evidence", "gene_evidence"):
        monkeypatch.setattr(QR, name, lambda *a: pytest.fail("evidence with payload"))


def test_evidence_branches_need_no_payload(spark, engine, monkeypatch):
    no_payload(monkeypatch)
    got = canonical(QR.evidence_branches(spark, SF).toPandas())
    assert got.equals(canonical(engine.sql(entry.oracle_sql()["e10_evidence_branches"]).df()))


def test_best_scores_need_no_payload(spark, engine, monkeypatch):
    no_payload(monkeypatch)
    got = canonical(QR.best_scores(spark, SF).toPandas())
    assert got.equals(canonical(engine.sql(entry.oracle_sql()["g08_best_scores"]).df()))


def test_feature_joins_need_no_payload(spark, engine, monkeypatch):
    no_payload(monkeypatch)
    got = canonical(QR.feature_joins(spark, SF).toPandas())
    assert got.equals(canonical(engine.sql(entry.oracle_sql()["f03_feature_joins"]).df()))


def test_audit_of_a_plan_saves_no_features(spark, engine, monkeypatch):
    monkeypatch.setattr(QR, "features", lambda *a: pytest.fail("features saved"))
    got = canonical(QD.branch_plan(spark, SF).toPandas())
    assert got.equals(canonical(engine.sql(entry.oracle_sql()["k19_branch_plan"]).df()))


def test_critic_saves_no_evidence_features_or_ranks(spark, engine, monkeypatch):
    no_payload(monkeypatch)
    saved, once = [], T.once
    monkeypatch.setattr(T, "once", lambda spark, sf, name, build: saved.append(name) or once(spark, sf, name, build))
    for name in ("f04_evidence_completeness", "k16_evidence_critic"):
        got = canonical(entry.queries()[name](spark, SF).toPandas())
        assert got.equals(canonical(engine.sql(entry.oracle_sql()[name]).df()))
    assert not {"features", "all_ranking"} & set(saved)


def test_candidate_rows_are_the_rows_of_the_features(spark):
    inputs = T.variants(spark, SF), S.gene_scores(spark, SF)
    rows = CA.candidate_rows(*inputs)
    want = CA.feature_rows(inputs[0], S.pedigree(spark, SF), inputs[1]).select(*rows.columns)
    assert rows.count() == want.count() and rows.exceptAll(want).count() == 0


def test_shards_of_a_corpus_are_made_once(spark):
    """Every reader of the selected records starts from the same saved shards."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    segments = spark.createDataFrame([("s", 0, 0, 4, 5), ("s", 1, 5, 9, 5)], "source string, shard long, first_row long, last_row long, records long")
    records = spark.range(10).select(F.lit("s").alias("source"), F.col("id").alias("ordinal"))
    references = spark.createDataFrame([("s", 1)], "source string, shard long")
    chosen = CO.selected_records(records, segments.mapInArrow(count, segments.schema), references)
    assert sorted(r.ordinal for r in chosen.collect()) == [5, 6, 7, 8, 9] and chosen.count() == 5
    assert made.value == 2


def test_lineage_of_branches_saves_no_features(spark, engine, monkeypatch):
    monkeypatch.setattr(QR, "features", lambda *a: pytest.fail("features saved"))
    got = canonical(QD.branch_lineage(spark, SF).toPandas())
    assert got.equals(canonical(engine.sql(entry.oracle_sql()["e07_branch_lineage"]).df()))


def test_export_deals_out_variants_and_writes_no_placed_rank(spark, engine, monkeypatch):
    """Evidence with its payload is made behind the shuffle; files stay in the order of the variants."""
    given, export = {}, QD.W.export_run
    monkeypatch.setattr(ordering, "place", lambda *a: pytest.fail("placed rows written"))
    monkeypatch.setattr(R, "PLACED_RANKS", 0)

    def run(path, evidence, *tables, **kw):
        given.update(path=path, plan=evidence._jdf.queryExecution().optimizedPlan().toString(), **kw)
        export(path, evidence, *tables, **kw)

    monkeypatch.setattr(QD.W, "export_run", run)
    got = canonical(QD.run_export(spark, SF).toPandas())
    assert got.equals(canonical(engine.sql(entry.oracle_sql()["b03_run_export"]).df()))
    assert given["dealt"] == ("evidence",) and given["plan"].index("to_json" if "to_json" in given["plan"] else "StructsToJson") < given["plan"].index("RepartitionByExpression")
    rows = spark.read.parquet(f"{given['path']}/evidence").select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "variant_id")
    files = {}
    for r in sorted(rows.collect(), key=lambda r: (r.file, r["at"])):
        files.setdefault(r.file, []).append(r.variant_id)
    assert files and all(ids == sorted(ids) for ids in files.values())


def test_consequences_are_saved_as_columns(spark):
    records = A.annotated_records(X.annotated_fields(spark, SF).select("f"))
    assert A.import_annotation(records, X.CSQ_LAYOUT)["consequences"].inputFiles()
