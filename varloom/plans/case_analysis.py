"""Analysis of all runs of a cohort in one application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom import constants as K
from varloom.operators import inheritance as I
from varloom.operators import ontology as O
from varloom.operators import pairs as P
from varloom.operators import ranking as R
from varloom.operators.evidence import inheritance_evidence, phenotype_evidence
from varloom.operators.ordering import checked_broadcast
from varloom.plans import branch_plan
from varloom.session import materialize, written

DATA_VERSION = "pedigree-input-v1"
MODELS = (*K.SINGLE_MODELS, "compound_heterozygous")


def gene_scores(variants: DataFrame, patient_terms: DataFrame, associations: DataFrame,
                ancestors: DataFrame) -> DataFrame:
    """Phenotype score of every gene that occurs in a run."""
    genes = variants.where("gene is not null").select("run_id", "gene")
    return O.phenotype_scores(patient_terms, genes, associations, ancestors)


def feature_rows(
    variants: DataFrame, pedigree: DataFrame, scores: DataFrame
) -> DataFrame:
    """Variants with all model fits and ranking features, in wide form.

    The models of a variant stay in one row, so the best inheritance score is a
    row expression and only the gene scores need a join.
    """
    wide = P.inheritance_table(I.with_trio(variants, pedigree))
    wide = wide.withColumn("inheritance_score", F.greatest(*[F.col(m) for m in MODELS]))
    genes = scores.select("run_id", F.col("gene").alias("_gene"), F.col("score").alias("phenotype_score"), "known")
    keyed = wide.withColumn("_gene", F.upper("gene"))
    kept = [
        "run_id",
        "variant_id",
        "row_id",
        "gene",
        "quality",
        "allele_frequency",
        "consequence",
        "clinvar_classification",
        "inheritance_score",
        *MODELS,
    ]
    joined = keyed.select(*kept, "_gene").join(genes, ["run_id", "_gene"], "left").drop("_gene")
    return R.ranking_features(joined)


def candidate_rows(variants: DataFrame, scores: DataFrame) -> DataFrame:
    """(run_id, variant_id, gene, known) of the rows of ``feature_rows``, for which no model is evaluated."""
    genes = scores.select("run_id", F.col("gene").alias("_gene"), "known")
    keyed = variants.select("run_id", "variant_id", "gene", F.upper("gene").alias("_gene"))
    return keyed.join(genes, ["run_id", "_gene"], "left").drop("_gene")


def scored_contexts(
    features: DataFrame, steps: list[branch_plan.Step] | None = None,
    chosen: list[dict] | None = None, limits: branch_plan.Limits = branch_plan.CASE_LIMITS,
) -> dict[str, DataFrame]:
    """Planned branches and one score per candidate and context."""
    planned = branch_plan.run_plan(features, steps, limits)
    scored = R.context_scores(planned["features"], chosen)
    return {**planned, "scored": scored}


def inheritance_rows(table: DataFrame) -> DataFrame:
    """Long evidence of the wide model table: one row per variant and model.

    The table already holds the winner of the single and the pair pass for every
    key, so the rows come out reduced and no shuffle is needed.
    """
    none = F.lit(None).cast("string")
    from_pair = F.col("compound.score") >= F.col("homozygous_recessive")

    def item(model: str, partner=none, phase=none):
        quality = "pedigree_quality" if model == "autosomal_dominant" else "trio_quality"
        return F.struct(
            F.lit(model).alias("method"),
            F.col(model).alias("score"),
            F.col(quality).alias("quality_checks_passed"),
            I.model_warnings(model).alias("warnings"),
            partner.alias("partner"),
            phase.alias("phase"),
        )

    partner, phase = F.col("compound.partner"), F.col("compound.phase")
    items = [item(m) for m in K.SINGLE_MODELS[:-1]]
    items.append(
        item("autosomal_recessive", F.when(from_pair, partner), F.when(from_pair, phase))
    )
    items.append(item("compound_heterozygous", partner, phase))
    return (
        table.select(
            "run_id",
            "variant_id",
            F.upper(F.coalesce("gene", F.lit("UNKNOWN"))).alias("gene"),
            F.col("_p.genotype").alias("proband_genotype"),
            F.col("_m.genotype").alias("mother_genotype"),
            F.col("_f.genotype").alias("father_genotype"),
            "row_id",
            F.explode(F.array(*items)).alias("e"),
        )
        .where("e.score is not null")
        .select("*", "e.*")
        .drop("e")
    )


def model_evidence(variants: DataFrame, pedigree: DataFrame, data_version: str = DATA_VERSION) -> DataFrame:
    """Evidence rows of all models of every variant."""
    table = P.inheritance_table(I.with_trio(variants, pedigree))
    return inheritance_evidence(inheritance_rows(table), data_version, F.col("row_id"))


def model_scores(variants: DataFrame, pedigree: DataFrame) -> DataFrame:
    """The rows of ``model_evidence`` without payload and provenance, for readers of scores alone."""
    table = P.inheritance_table(I.with_trio(variants, pedigree))
    items = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in MODELS])
    return (
        table.select("run_id", "variant_id", F.upper(F.coalesce("gene", F.lit("UNKNOWN"))).alias("gene"), F.explode(items).alias("e"))
        .where("e.score is not null")
        .select("run_id", "variant_id", "gene", "e.method", "e.score", F.lit(True).alias("known"))
    )


def score_evidence(variants: DataFrame, pedigree: DataFrame, scores: DataFrame) -> DataFrame:
    """The rows of ``long_evidence`` with their scores alone: no payload is written as text and saved."""
    models = model_scores(variants, pedigree)
    return models.unionByName(phenotype_evidence(scores, DATA_VERSION).select(*models.columns))


def long_evidence(
    variants: DataFrame, pedigree: DataFrame, scores: DataFrame, data_version: str = DATA_VERSION
) -> DataFrame:
    """Saved evidence rows of a cohort: all models of every variant and all gene scores."""
    return model_evidence(variants, pedigree, data_version).unionByName(phenotype_evidence(scores, data_version))


def evidence_of(
    variants: DataFrame, pedigree: DataFrame, scores: DataFrame, wanted: DataFrame, data_version: str = DATA_VERSION
) -> DataFrame:
    """The rows of ``long_evidence`` that belong to the ``wanted`` (run_id, variant_id) or to their genes.

    For few variants of a cohort: only rows of their genes can be their partners in a pair, so no
    other row is evaluated.
    """
    keys = checked_broadcast(materialize(wanted.select("run_id", "variant_id").distinct()))
    named = variants.withColumn("_gene", F.upper("gene"))
    own, _ = written(named.join(keys, ["run_id", "variant_id"], "left_semi"), "wanted")
    genes = checked_broadcast(materialize(own.where("_gene is not null").select("run_id", "_gene").distinct()))
    can_pair = F.coalesce(~F.trim("_gene").isin(*K.PLACEHOLDER_GENES), F.lit(False))
    shared = named.where(can_pair).join(genes, ["run_id", "_gene"], "left_semi").select(*own.columns)
    rows, _ = written(shared.unionByName(own.where(~can_pair)).drop("_gene"), "related")
    models = model_evidence(rows, pedigree, data_version).join(keys, ["run_id", "variant_id"], "left_semi")
    held = scores.join(genes.withColumnRenamed("_gene", "gene"), ["run_id", "gene"], "left_semi")
    return models.unionByName(phenotype_evidence(held.select(*scores.columns), data_version))


def last_terms(patient_terms: DataFrame) -> DataFrame:
    """(run_id, hpo_id): the term that only the last position of a run holds; runs of one position keep it."""
    last = patient_terms.groupBy("run_id").agg(F.max("position").alias("_last"), F.min("position").alias("_first"))
    held = patient_terms.join(last.where("_first < _last"), "run_id")
    # a term that an earlier position holds too is not lost with the last one
    return held.groupBy("run_id", "hpo_id").agg(
        F.min("position").alias("_at"), F.max("_last").alias("_last")
    ).where("_at = _last").select("run_id", "hpo_id")


def term_ablation(
    rows: DataFrame, patient_terms: DataFrame, associations: DataFrame, ancestors: DataFrame, truth: DataFrame
) -> DataFrame:
    """Gene score and rank of the labelled variants with all terms and without the last one.

    ``rows``: run_id, variant_id, gene, quality, allele_frequency, consequence and
    inheritance_score, as in a feature table. One pass: the gene scores give both values,
    every variant gets both weighted scores, and the variants ahead of a label are counted
    for both at once.
    """
    genes = rows.where("gene is not null").select("run_id", "gene").distinct()
    scores = O.phenotype_scores(patient_terms, genes, associations, ancestors, last_terms(patient_terms))
    rows = rows.select(
        "run_id", "variant_id", F.upper("gene").alias("gene"), "quality", "allele_frequency", "consequence", "inheritance_score"
    ).join(scores.select("run_id", "gene", "score", "score_without"), ["run_id", "gene"], "left")
    weights = dict(zip(K.FEATURES, K.DEFAULT_WEIGHTS, strict=True))
    for name, gene_score in (("full", "score"), ("partial", "score_without")):
        rows = R.ranking_features(rows.withColumn("phenotype_score", F.col(gene_score))).withColumn(
            f"_{name}", R.weighted_score(weights, K.BASE_MODE)
        )
    scored, _ = written(rows.select("run_id", "variant_id", "_full", "_partial", "score", "score_without"), "scored")
    labels = truth.select("run_id", "variant_id").distinct()
    targets = scored.join(labels, ["run_id", "variant_id"], "left_semi")
    return ranks_of(scored, targets, ["_full", "_partial"]).select(
        "run_id", "variant_id",
        F.col("_full_rank").alias("full_rank"), F.col("_partial_rank").alias("partial_rank"),
        F.coalesce("score", F.lit(0.0)).alias("full_score"), F.coalesce("score_without", F.lit(0.0)).alias("partial_score"),
    ).withColumn("score_delta", F.round(F.col("full_score") - F.col("partial_score"), 6))


def ranks_of(scored: DataFrame, targets: DataFrame, columns: list[str]) -> DataFrame:
    """Targets with ``<column>_rank``: 1 + the variants of the run ahead of each, by score and id.

    The targets (few of a run) go to the variants behind a check of their size, and the counts of
    all columns are one partial aggregate.
    """
    marks = materialize(targets.select("run_id", F.col("variant_id").alias("_v"), *[F.col(c).alias(f"_s{c}") for c in columns]))

    def ahead(c: str):
        return (F.col(c) > F.col(f"_s{c}")) | ((F.col(c) == F.col(f"_s{c}")) & (F.col("variant_id") < F.col("_v")))

    counted = (
        scored.select("run_id", "variant_id", *columns).join(checked_broadcast(marks), "run_id")
        .groupBy("run_id", F.col("_v").alias("variant_id"))
        .agg(*[(F.count_if(ahead(c)) + 1).alias(f"{c}_rank") for c in columns])
    )
    return targets.join(counted, ["run_id", "variant_id"])
