"""Named reversible candidate sets.

Membership is a long table (run_id, variant_id, branch, active). A branch is
never changed in place: every operation adds rows for a new name, with one
lineage row (run-independent, small) describing how it was made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom import constants as K
from varloom.session import DataCheckError, dbl, require_empty

MEMBERSHIP = ["run_id", "variant_id", "branch", "active"]


def seed(variants: DataFrame, check: bool = True) -> DataFrame:
    """Branch ``all``: every variant once."""
    if check:
        require_empty(
            variants.groupBy("run_id", "variant_id").count().where("count > 1"),
            "variant ids must be unique in a run",
        )
    return variants.select("run_id", "variant_id", F.lit("all").alias("branch"), F.lit(True).alias("active"))


def _rows(membership: DataFrame, branch: str) -> DataFrame:
    return membership.where((F.col("branch") == branch) & F.col("active"))


def _named(rows: DataFrame, target: str) -> DataFrame:
    return rows.select("run_id", "variant_id", F.lit(target).alias("branch"), F.lit(True).alias("active"))


def copy_branch(membership: DataFrame, source: str, target: str) -> DataFrame:
    return membership.unionByName(_named(_rows(membership, source), target))


def filter_branch(
    membership: DataFrame, variants: DataFrame, source: str, target: str, predicate: Column
) -> DataFrame:
    """Target = source rows whose variant satisfies ``predicate``; the source stays."""
    kept = variants.where(predicate).select("run_id", "variant_id")
    rows = _rows(membership, source).join(kept, ["run_id", "variant_id"], "left_semi")
    return membership.unionByName(_named(rows, target))


def branch_from_ids(membership: DataFrame, source: str, target: str, ids: DataFrame) -> DataFrame:
    rows = _rows(membership, source).join(ids, ["run_id", "variant_id"], "left_semi")
    return membership.unionByName(_named(rows, target))


def union_branches(membership: DataFrame, names: list[str], target: str) -> DataFrame:
    if len(names) < 2:
        raise ValueError("a union needs at least two branches")
    rows = membership.where(F.col("branch").isin(*names) & F.col("active"))
    return membership.unionByName(_named(rows.select("run_id", "variant_id").distinct(), target))


def delete_branch(membership: DataFrame, branch: str) -> DataFrame:
    if branch == "all":
        raise ValueError("the branch 'all' cannot be deleted")
    return membership.where(F.col("branch") != branch)


def evidence_flags(
    phenotype: float = K.PHENOTYPE_PRIORITY, inheritance: float = K.INHERITANCE_PRIORITY
) -> dict[str, Column]:
    """Predicates of the evidence branches over a feature table."""
    return {
        "phenotype-priority": F.coalesce(F.col("phenotype_score") >= dbl(phenotype), F.lit(False)),
        "inheritance-priority": F.coalesce(
            F.col("inheritance_score") >= dbl(inheritance), F.lit(False)
        ),
        "novel-gene-rescue": ~F.coalesce(F.col("known"), F.lit(False)),
    }


def evidence_branches(
    membership: DataFrame, variants: DataFrame, evidence: DataFrame, source: str = "all"
) -> DataFrame:
    """Phenotype and inheritance priority and novel-gene rescue, from reduced evidence."""
    base = _rows(membership, source).join(
        variants.select("run_id", "variant_id", F.upper("gene").alias("gene")),
        ["run_id", "variant_id"],
    )
    is_gene = F.col("method") == K.PHENOTYPE_METHOD
    genes = evidence.where(is_gene).groupBy("run_id", "gene").agg(
        F.bool_or(F.col("score") >= dbl(K.PHENOTYPE_PRIORITY)).alias("_strong_gene"), F.bool_or("known").alias("_known")
    )
    strong_variants = evidence.where(~is_gene & (F.col("score") >= dbl(K.INHERITANCE_PRIORITY))).select("run_id", "variant_id")
    flagged = base.join(genes, ["run_id", "gene"], "left").join(
        strong_variants.distinct().withColumn("_strong", F.lit(True)), ["run_id", "variant_id"], "left"
    )
    # one pass: every row names the branches that it is in
    flags = {"phenotype-priority": "_strong_gene", "inheritance-priority": "_strong", "novel-gene-rescue": "not coalesce(_known, false)"}
    names = F.array_compact(F.array(*[F.when(F.expr(flag), F.lit(name)) for name, flag in flags.items()]))
    rows = flagged.select("run_id", "variant_id", F.explode(names).alias("branch"), F.lit(True).alias("active"))
    return membership.unionByName(rows)


def branch_counts(membership: DataFrame) -> DataFrame:
    return membership.where("active").groupBy("run_id", "branch").agg(F.count(F.lit(1)).alias("n"))


def lineage_table(spark, steps: list[tuple[str, list[str], str]]) -> DataFrame:
    """Lineage of branches made in order by (target, sources, operation).

    One source: stage and operations extend the parent's. Several sources (a
    union): no parent, stage is the largest source stage + 1.
    """
    known: dict[str, tuple[int, str | None, list[str]]] = {"all": (0, None, [])}
    for target, sources, operation in steps:
        if target in known:
            raise DataCheckError(f"branch {target!r} exists")
        missing = [s for s in sources if s not in known]
        if missing:
            raise DataCheckError(f"unknown source branch {missing}")
        stage = max(known[s][0] for s in sources) + 1
        single = len(sources) == 1
        parent = sources[0] if single else None
        history = known[sources[0]][2] if single else []
        known[target] = (stage, parent, [*history, operation])
    rows = [(name, stage, parent, ops) for name, (stage, parent, ops) in known.items()]
    return spark.createDataFrame(
        rows, "branch string, stage int, parent string, operations array<string>"
    )


def branch_summaries(membership: DataFrame, lineage: DataFrame) -> DataFrame:
    """Every branch of the lineage with its active count per run; zero counts included.

    The lineage may be one for all runs or one per run (``run_id``).
    """
    if "run_id" in lineage.columns:
        grid = lineage
    else:
        names = F.broadcast(lineage)  # one row per plan step, fixed by the plan
        grid = membership.select("run_id").distinct().join(names, F.lit(True))
    return grid.join(branch_counts(membership), ["run_id", "branch"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def branch_rows(membership: DataFrame, variants: DataFrame, branch: str) -> DataFrame:
    """Variants of a branch in source order."""
    keys = _rows(membership, branch).select("run_id", "variant_id")
    return variants.join(keys, ["run_id", "variant_id"], "left_semi").orderBy("run_id", "row_id")


def sample_rows(branch: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows per run in source order, five fields without coordinates."""
    from varloom.operators.ordering import top_within

    return top_within(branch, ["run_id"], [F.col("row_id")], n, "_n").select(
        "run_id", "gene", "consequence", "quality", "allele_frequency", "clinvar_classification"
    )


def branch_stats(branch: DataFrame) -> DataFrame:
    """Per run: count, and missing/min/max of quality and frequency."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in ("quality", "allele_frequency"):
        aggs += [
            F.count_if(F.col(c).isNull()).alias(f"{c}_missing"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
    return branch.groupBy("run_id").agg(*aggs)


def category_counts(branch: DataFrame, k: int = 30) -> DataFrame:
    """Per run: the ``k`` most frequent consequence and ClinVar values, NULL as ``missing``."""
    from varloom.operators.ordering import top_within

    kinds = F.array(
        F.struct(F.lit("consequence").alias("kind"), F.col("consequence").alias("category")),
        F.struct(F.lit("clinvar").alias("kind"), F.col("clinvar_classification").alias("category")),
    )
    counted = (
        branch.select("run_id", F.explode(kinds).alias("x"))
        .select("run_id", "x.kind", F.coalesce("x.category", F.lit("missing")).alias("category"))
        .groupBy("run_id", "kind", "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_within(counted, ["run_id", "kind"], [F.col("n").desc(), F.col("category")], k)


def survival(membership: DataFrame, truth: DataFrame, lineage: DataFrame) -> DataFrame:
    """Per branch: in how many runs it still holds the labelled variant."""
    held = membership.where("active").join(
        truth.select("run_id", "variant_id"), ["run_id", "variant_id"], "left_semi"
    )
    counts = held.groupBy("branch").agg(F.count(F.lit(1)).alias("held"))
    return lineage.select("branch").join(counts, "branch", "left").withColumn(
        "held", F.coalesce("held", F.lit(0))
    )


def rescue_retention(membership: DataFrame, ranking: DataFrame, context: str = K.BASE_MODE) -> DataFrame:
    """Per run: share of the rescue branch that is ranked; 1 for an empty rescue branch."""
    rescue = _rows(membership, "novel-gene-rescue").select("run_id", "variant_id")
    ranked = ranking.where(F.col("context") == context).select(
        "run_id", "variant_id", F.lit(1).alias("_ranked")
    )
    runs = membership.select("run_id").distinct()
    counts = (
        rescue.join(ranked, ["run_id", "variant_id"], "left")
        .groupBy("run_id")
        .agg(F.count(F.lit(1)).alias("rescued"), F.count("_ranked").alias("retained"))
    )
    return runs.join(counts, "run_id", "left").select(
        "run_id",
        F.coalesce("rescued", F.lit(0)).alias("rescued"),
        F.coalesce("retained", F.lit(0)).alias("retained"),
        F.when(F.col("rescued") > 0, F.col("retained") / F.col("rescued"))
        .otherwise(dbl(1))
        .alias("retention"),
    )
