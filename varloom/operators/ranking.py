"""Features, weighted scores under many contexts, and deterministic ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom import constants as K
from varloom.functions.fields import literal_map
from varloom.operators.ordering import checked_broadcast, rank_within, top_within
from varloom.session import dbl, materialize, score_round, written


def feature_quality(quality: Column) -> Column:
    return F.when(quality.isNull(), dbl(0.5)).otherwise(
        F.least(F.greatest(quality / dbl(100), dbl(0)), dbl(1))
    )


def feature_rarity(frequency: Column) -> Column:
    return F.when(frequency.isNull(), dbl(0.6)).otherwise(
        F.greatest(dbl(0), dbl(1) - F.least(frequency / dbl(0.01), dbl(1)))
    )


def consequence_score(term: Column) -> Column:
    table = literal_map(K.CONSEQUENCE_SCORES)
    return F.coalesce(table[F.coalesce(term, F.lit(""))], dbl(K.DEFAULT_CONSEQUENCE_SCORE))


def ranking_features(df: DataFrame) -> DataFrame:
    """Add ``features`` from quality, allele_frequency, consequence and the two scores."""
    return df.withColumn(
        "features",
        F.struct(
            score_round(feature_quality(F.col("quality"))).alias("quality"),
            score_round(feature_rarity(F.col("allele_frequency"))).alias("rarity"),
            consequence_score(F.col("consequence")).alias("consequence"),
            score_round(F.coalesce("phenotype_score", dbl(0))).alias("phenotype"),
            score_round(F.coalesce("inheritance_score", dbl(0))).alias("inheritance"),
        ),
    )


def feature_table(
    variants: DataFrame, gene_scores: DataFrame, variant_scores: DataFrame
) -> DataFrame:
    """Variants with best gene and variant scores (missing = 0 in the features).

    Both evidence sides hold one row per key already, so neither join grows.
    """
    genes = gene_scores.select(
        "run_id", F.col("gene").alias("_gene"), "phenotype_score", "known"
    )
    scores = variant_scores.select("run_id", "variant_id", "inheritance_score")
    keyed = variants.withColumn("_gene", F.upper("gene"))
    joined = keyed.join(genes, ["run_id", "_gene"], "left").join(
        scores, ["run_id", "variant_id"], "left"
    )
    return ranking_features(joined).drop("_gene")


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    """Weights must name the five features, be finite, non-negative and not all zero."""
    if set(weights) != set(K.FEATURES):
        raise ValueError(f"weights must define exactly {K.FEATURES}")
    if any(not math.isfinite(w) or w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must be finite, non-negative and have a positive sum")
    return weights


def score_text(weights: dict[str, float], mode: str) -> str:
    """SQL text of the weighted score over a ``features`` struct."""
    included = K.MODES[mode]
    total = sum(weights[name] for name in included)
    if total <= 0:
        raise ValueError(f"weights of {mode} sum to zero")
    terms = " + ".join(f"features.{name} * {weights[name]!r}D" for name in included)
    return f"round(({terms}) / {total!r}D + 1e-9D, 6)"


def weighted_score(weights: dict[str, float], mode: str) -> Column:
    return F.expr(score_text(check_weights(weights), mode))


def contexts(include_defaults: bool = True) -> list[dict]:
    """The 28 ranking contexts: 4 default modes and 6 strategies x 4 modes."""
    rows = []
    sets = [("", K.DEFAULT_WEIGHTS)] if include_defaults else []
    sets += [(name, values) for name, values in K.STRATEGIES.items()]
    for strategy, values in sets:
        weights = dict(zip(K.FEATURES, values, strict=True))
        for mode in K.MODES:
            rows.append(
                {
                    "context": f"{strategy}_{mode}" if strategy else mode,
                    "mode": mode,
                    "branch": "conservative" if strategy == "conservative" else "ensemble",
                    "weights": weights,
                }
            )
    return rows


def context_scores(features: DataFrame, chosen: list[dict] | None = None) -> DataFrame:
    """One row per candidate and context, without a join: the contexts are a literal array.

    ``features`` may carry ``branches`` (array of branch names); a context then
    only takes candidates of its branch.
    """
    chosen = contexts() if chosen is None else chosen
    items = ", ".join(
        f"named_struct('context', '{c['context']}', 'branch', '{c['branch']}', "
        f"'score', {score_text(check_weights(c['weights']), c['mode'])})"
        for c in chosen
    )
    exploded = features.withColumn("_c", F.explode(F.expr(f"array({items})")))
    if "branches" in features.columns:
        exploded = exploded.where(F.array_contains("branches", F.col("_c.branch")))
    return exploded.withColumn("context", F.col("_c.context")).withColumn(
        "score", F.col("_c.score")
    ).drop("_c")


#: Ranks up to which placed rows are written: for few rows that is cheaper than to count their steps first.
PLACED_RANKS = 2_000_000
RANK_ORDER = ("score desc", "variant_id")


def rank_order() -> list[Column]:
    return [F.col("score").desc(), F.col("variant_id")]


def rank_candidates(scored: DataFrame) -> DataFrame:
    """Full rank of every candidate per run and context; safe for one huge run."""
    return rank_within(scored, ["run_id", "context"], rank_order())


def context_ranks(features: DataFrame, chosen: list[dict] | None = None, carry: list[str] | None = None) -> DataFrame:
    """Full rank of every candidate per run in every chosen context, as of its ``context_scores``.

    (run_id, context, variant_id, score, rank) and the ``carry`` columns. The rounded scores of a
    candidate are written once, in one row, as the ranks read them twice and, beyond ``PLACED_RANKS``,
    write no placed row; a context is a number until its rows are placed. Contexts of the same score and branch are one number, placed
    once, and get their names back with the ranks. A context that takes no candidate of a row's
    branches holds no struct there.
    """
    chosen = contexts() if chosen is None else chosen
    kept = ["run_id", "variant_id", *(carry or [])]
    branches = {c["branch"]: f"_in_{i}" for i, c in enumerate(chosen)}
    known = "branches" in features.columns
    orders: dict[tuple, list[str]] = {}
    for c in chosen:
        key = (score_text(check_weights(c["weights"]), c["mode"]), branches[c["branch"] if known else chosen[0]["branch"]])
        orders.setdefault(key, []).append(c["context"])
    marked = features.withColumns(
        {name: F.array_contains("branches", b) if known else F.lit(True) for b, name in branches.items()}
    )
    items = ", ".join(
        f"if({branch}, named_struct('score', {text}), null)" for text, branch in orders
    )
    wide, n = written(marked.select(*kept, F.expr(f"array({items})").alias("_scores")), "scores")
    long = wide.select(*kept, F.posexplode("_scores").alias("_c", "_s")).where("_s is not null")
    by = "score" if n * len(orders) > PLACED_RANKS else None
    ranked = rank_within(long.select(*kept, "_c", "_s.score"), ["run_id", "_c"], rank_order(), "rank", by)
    names = F.array(*[F.array(*[F.lit(name) for name in held]) for held in orders.values()])
    return ranked.select("run_id", F.explode(F.get(names, F.col("_c"))).alias("context"), *kept[1:], "score", "rank")


def top_candidates(scored: DataFrame, k: int) -> DataFrame:
    """First ``k`` candidates per run and context with their rank."""
    return top_within(scored, ["run_id", "context"], rank_order(), k)


def ranking_rows(ranking: DataFrame, context: str, limit: int = 100) -> DataFrame:
    if limit < 1:
        raise ValueError("a page holds at least one row")
    return ranking.where((F.col("context") == context) & (F.col("rank") <= limit))


def contributions(ranking: DataFrame, weights: dict[str, float], mode: str) -> DataFrame:
    """Share of each included feature in the score; the shares add up to it."""
    check_weights(weights)
    included = K.MODES[mode]
    total = sum(weights[n] for n in included)
    shares = [
        (F.col(f"features.{n}") * dbl(weights[n]) / dbl(total)).alias(n) for n in included
    ]
    return ranking.withColumn("contributions", F.struct(*shares))


def ranking_integrity(ranking: DataFrame) -> DataFrame:
    """Per run and context: counts that show whether ids and ranks are a permutation.

    The counts are plain sums: ranks 1..n are a permutation exactly when the
    (run, context, rank) and (run, context, id) groups are all of size one.
    """
    group = ["run_id", "context"]
    ids = ranking.groupBy(*group, "variant_id").count().groupBy(*group).agg(
        F.count(F.lit(1)).alias("distinct_ids"), F.sum("count").alias("rows")
    )
    ranks = ranking.groupBy(*group, "rank").count().groupBy(*group).agg(
        F.count(F.lit(1)).alias("distinct_ranks"),
        F.min("rank").alias("lowest"),
        F.max("rank").alias("highest"),
    )
    ok = (
        (F.col("rows") == F.col("distinct_ids"))
        & (F.col("rows") == F.col("distinct_ranks"))
        & (F.col("lowest") == 1)
        & (F.col("highest") == F.col("rows"))
    )
    return ids.join(ranks, group).withColumn("valid", ok)


def score_mismatches(ranking: DataFrame, chosen: list[dict]) -> DataFrame:
    """Rows whose saved score differs from the one the features give (above 1e-6)."""
    cases = F.lit(None).cast("double")
    for c in chosen:
        expected = F.expr(score_text(c["weights"], c["mode"]))
        cases = F.when(F.col("context") == c["context"], expected).otherwise(cases)
    difference = F.abs(F.col("score") - cases)
    return ranking.where(difference.isNull() | (difference > dbl(1e-6)))


def label_ranks(features: DataFrame, truth: DataFrame, chosen: list[dict] | None = None) -> DataFrame:
    """The rows of ``label_ablations`` over ``context_ranks``, without placing any other candidate.

    A candidate's scores are one row, NULL outside its branches; the candidates ahead of each label
    are counted for all contexts at once. A context without a candidate in a run gives no row.
    """
    chosen = contexts() if chosen is None else chosen
    known = "branches" in features.columns
    scores = []
    for i, c in enumerate(chosen):
        score = F.expr(score_text(check_weights(c["weights"]), c["mode"]))
        scores.append((F.when(F.array_contains("branches", c["branch"]), score) if known else score).alias(f"_{i}"))
    wide, _ = written(features.select("run_id", "variant_id", *scores), "scores")
    runs = truth.select("run_id", "variant_id")
    own = wide.join(checked_broadcast(materialize(runs.distinct())), ["run_id", "variant_id"], "left_semi")
    marks = materialize(
        runs.distinct().join(own, ["run_id", "variant_id"], "left")
        .select("run_id", F.col("variant_id").alias("_v"), *[F.col(f"_{i}").alias(f"_s{i}") for i in range(len(chosen))])
    )

    def ahead(i: int) -> Column:
        tie = (F.col(f"_{i}") == F.col(f"_s{i}")) & (F.col("variant_id") < F.col("_v"))
        return (F.col(f"_{i}") > F.col(f"_s{i}")) | tie

    counted = wide.join(checked_broadcast(marks), "run_id").groupBy("run_id", "_v").agg(
        *[F.count(f"_{i}").alias(f"_n{i}") for i in range(len(chosen))],
        *[F.when(F.first(f"_s{i}").isNotNull(), F.count_if(ahead(i)) + 1).alias(f"_r{i}") for i in range(len(chosen))],
    )
    rows = F.array(*[
        F.struct(F.lit(c["context"]).alias("context"), F.col(f"_n{i}").alias("n"), F.col(f"_r{i}").alias("rank"))
        for i, c in enumerate(chosen)
    ])
    found = counted.select("run_id", F.col("_v").alias("variant_id"), F.explode(rows).alias("_c")).where("_c.n > 0")
    return _ablation_rows(runs.join(found.select("run_id", "variant_id", "_c.context", "_c.rank"), ["run_id", "variant_id"]))


def label_ablations(ranking: DataFrame, truth: DataFrame) -> DataFrame:
    """Rank of the labelled variant in every context and its top-1/5/10 flags."""
    runs = truth.select("run_id", "variant_id")
    names = ranking.select("run_id", "context").distinct()
    found = runs.join(names, "run_id").join(
        ranking.select("run_id", "context", "variant_id", "rank"),
        ["run_id", "context", "variant_id"],
        "left",
    )
    return _ablation_rows(found)


def _ablation_rows(found: DataFrame) -> DataFrame:
    return found.select(
        "run_id",
        "context",
        "variant_id",
        "rank",
        *[F.coalesce(F.col("rank") <= k, F.lit(False)).alias(f"top_{k}") for k in (1, 5, 10)],
    )
