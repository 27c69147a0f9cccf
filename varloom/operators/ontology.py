"""Ontology graph, term normalisation and gene-phenotype similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom import constants as K
from varloom.operators.ordering import checked_broadcast
from varloom.session import DataCheckError, dbl, materialize, score_round, written


#: Rounds after which the pairs known before are taken away from the newest ones.
PRUNED = 8


def proper_ancestors(edges: DataFrame) -> DataFrame:
    """(term, ancestor) for every path of one edge or more over edges of the same columns.

    Semi-naive: only the pairs found last meet the edges. On paths of growing length they end by
    themselves, and a pair comes again only by a path of another length, so the known pairs are
    not read in every round: every ``PRUNED`` rounds an anti-join takes them away, which bounds
    the repeats and ends the loop on a cycle. Every round is written, so a lost executor repeats
    one round.
    """
    edges, n = written(edges.distinct(), "edges")
    further = edges.select(F.col("term").alias("ancestor"), F.col("ancestor").alias("_next"))
    parts, newest, rounds = [edges], edges, 0
    while n:
        rounds += 1
        step = newest.join(further, "ancestor").select("term", F.col("_next").alias("ancestor")).distinct()
        if rounds % PRUNED == 0:
            known = written(reduce(DataFrame.unionByName, parts).distinct(), "ancestors")[0]
            step, parts = step.join(known, ["term", "ancestor"], "left_anti"), [known]
        newest, n = written(step, "ancestors")
        parts.append(newest)
    return reduce(DataFrame.unionByName, parts).distinct()


def _parent_edges(terms: DataFrame) -> DataFrame:
    edges = terms.select(F.col("hpo_id").alias("term"), F.explode("parents").alias("ancestor"))
    return edges.where("term is not null and ancestor is not null")


def closure(terms: DataFrame) -> DataFrame:
    """(term, ancestor) for every ancestor of every term, the term itself included.

    A parent missing from the table still counts as an ancestor.
    """
    own = terms.select(F.col("hpo_id").alias("term"), F.col("hpo_id").alias("ancestor"))
    return own.unionByName(proper_ancestors(_parent_edges(terms).where("term <> ancestor")))


def cyclic_terms(terms: DataFrame) -> DataFrame:
    """Nodes that are their own proper ancestor (must be empty for a DAG or pedigree)."""
    return proper_ancestors(_parent_edges(terms)).where("term = ancestor").select("term").distinct()


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): component is the smallest node name reachable.

    Min-label propagation with pointer jumping; a hub only ever adds one
    partially aggregated minimum per task.
    """
    both = (
        edges.select(F.col("left").alias("node"), F.col("right").alias("other"))
        .unionByName(edges.select(F.col("right").alias("node"), F.col("left").alias("other")))
        .where("node <> other")
        .distinct()
    )
    both = materialize(both)
    names = both.select("node")
    if nodes is not None:
        names = names.unionByName(nodes.select("node"))
    labels = materialize(names.distinct().withColumn("component", F.col("node")))
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "other"), "other")
            .groupBy("node")
            .agg(F.min("component").alias("_near"))
        )
        stepped = labels.join(near, "node", "left").select(
            "node", F.least("component", "_near").alias("component")
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("_jump"))
        moved = materialize(
            stepped.join(jump, "component", "left")
            .select("node", F.least("component", "_jump").alias("component"))
        )
        changed = moved.join(
            labels.withColumnRenamed("component", "_old"), "node"
        ).where(F.col("component") != F.col("_old"))
        done = changed.limit(1).count() == 0
        labels = moved
        if done:
            return labels


def normalize_terms(patient_terms: DataFrame, terms: DataFrame, key: str = "run_id") -> DataFrame:
    """Status of every given term id of a case (``key``, position, raw).

    status: invalid, unknown, obsolete_dropped, duplicate or kept; ``replaced``
    marks an obsolete id that was followed to its replacement.
    """
    value = F.upper(F.trim("raw"))
    known = terms.select("hpo_id", "obsolete", "replaced_by")
    successor = terms.select(
        F.col("hpo_id").alias("replaced_by"), F.lit(True).alias("_has_successor")
    )
    lookup = known.join(successor, "replaced_by", "left")
    joined = patient_terms.withColumn("value", value).join(
        lookup.withColumnRenamed("hpo_id", "value"), "value", "left"
    )
    replaced = F.coalesce(F.col("obsolete"), F.lit(False)) & F.coalesce(
        F.col("_has_successor"), F.lit(False)
    )
    resolved = joined.select(
        key,
        "position",
        "raw",
        "value",
        replaced.alias("replaced"),
        F.when(~F.col("value").rlike(f"^{K.TERM_PATTERN}$"), "invalid")
        .when(F.col("obsolete").isNull(), "unknown")
        .when(F.col("obsolete") & ~replaced, "obsolete_dropped")
        .otherwise("kept")
        .alias("_status"),
        F.when(replaced, F.col("replaced_by")).otherwise(F.col("value")).alias("_term"),
    )
    # the first position of a kept term is a partial aggregate, so a term repeated
    # any number of times in a case never gathers on one task
    first = (
        resolved.where("_status = 'kept'")
        .groupBy(key, "_term")
        .agg(F.min("position").alias("_first"))
    )
    kept = F.col("_status") == "kept"
    return resolved.join(first, [key, "_term"], "left").select(
        key,
        "position",
        "raw",
        "replaced",
        F.when(kept & (F.col("position") > F.col("_first")), "duplicate")
        .otherwise(F.col("_status"))
        .alias("status"),
        F.when(kept & (F.col("position") == F.col("_first")), F.col("_term")).alias("hpo_id"),
    )


def resolve_associations(associations: DataFrame, terms: DataFrame) -> DataFrame:
    """Usable associations: NOT rows removed, obsolete terms followed to the replacement."""
    replaced = terms.where("obsolete and replaced_by is not null").select(
        "hpo_id", F.col("replaced_by").alias("_to")
    )
    return (
        associations.where(~F.col("qualifier").eqNullSafe(F.lit("NOT")))
        .join(replaced, "hpo_id", "left")
        .withColumn("hpo_id", F.coalesce("_to", "hpo_id"))
        .drop("_to")
    )


def lookup_terms(
    keys: DataFrame, associations: DataFrame, terms: DataFrame, key: str
) -> DataFrame:
    """All associations of the given genes or diseases."""
    return resolve_associations(associations, terms).join(keys.distinct(), key, "left_semi")


def information_content(associations: DataFrame, closed: DataFrame) -> DataFrame:
    """(term, genes, ic): ic = -ln((genes at or below + 1) / (all genes + 1)).

    The distinct count aggregates (term, gene) first, so the root, which holds
    every gene, is counted from partial counts.
    """
    genes = associations.select(F.upper("gene").alias("gene"), F.col("hpo_id").alias("term"))
    total = genes.agg(F.greatest(F.lit(1), F.countDistinct("gene"))).scalar()
    counted = (
        genes.distinct()
        .join(closed, "term")
        .groupBy("ancestor")
        .agg(F.countDistinct("gene").alias("genes"))
    )
    ratio = (F.col("genes") + 1).cast("double") / (total + F.lit(1)).cast("double")
    return counted.select(
        F.col("ancestor").alias("term"), "genes", (-F.log(ratio)).alias("ic")
    )


def informative_ancestors(closed: DataFrame, ic: DataFrame) -> DataFrame:
    """(term, ancestor, sim) with sim = ic / largest ic, for ancestors with ic > 0.

    Ancestors without information can only contribute 0, the default, so the
    root and the other uninformative hubs never enter a join.
    """
    top = ic.agg(F.max("ic")).scalar()
    weights = ic.where(F.col("ic") > 0).select(
        F.col("term").alias("ancestor"), F.least(dbl(1), F.col("ic") / top).alias("sim")
    )
    return closed.join(weights, "ancestor").select("term", "ancestor", "sim")


def term_similarity(left: DataFrame, right: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(left, right, sim) of two term lists: best shared ancestor. Zero pairs are not listed."""
    a = left.select(F.col("term").alias("left")).distinct()
    b = right.select(F.col("term").alias("right")).distinct()
    la = a.join(ancestors.withColumnRenamed("term", "left"), "left")
    rb = b.join(ancestors.withColumnRenamed("term", "right"), "right").select("right", "ancestor")
    return la.join(rb, "ancestor").groupBy("left", "right").agg(F.max("sim").alias("sim"))


def _associated(wanted: DataFrame, associations: DataFrame) -> DataFrame:
    """(gene, term) of the associations of the wanted genes, repeats kept."""
    return associations.select(F.upper("gene").alias("gene"), F.col("hpo_id").alias("term")).join(
        wanted.select("gene").distinct(), "gene", "left_semi"
    )


def _matched(patient: DataFrame, assoc: DataFrame) -> DataFrame:
    return (
        patient.select("run_id", "term").distinct().join(assoc.distinct(), "term")
        .groupBy("run_id", "gene")
        .agg(F.array_sort(F.collect_list("term")).alias("matched_terms"))
    )


def matched_terms(patient_terms: DataFrame, genes: DataFrame, associations: DataFrame) -> DataFrame:
    """(run_id, gene, matched_terms) of every requested (run, gene): no graph and no score is needed for it."""
    wanted = genes.select("run_id", F.upper("gene").alias("gene")).distinct()
    matched = _matched(patient_terms.select("run_id", F.col("hpo_id").alias("term")), _associated(wanted, associations))
    return wanted.join(matched, ["run_id", "gene"], "left").withColumn(
        "matched_terms", F.coalesce("matched_terms", F.array().cast("array<string>"))
    )


def phenotype_scores(
    patient_terms: DataFrame,
    genes: DataFrame,
    associations: DataFrame,
    ancestors: DataFrame,
    dropped: DataFrame | None = None,
) -> DataFrame:
    """Best-match-average score of every requested (run, gene).

    ``patient_terms`` (run_id, hpo_id), ``genes`` (run_id, gene). Only requested genes
    are scored. Neither side lists term pairs: a patient term meets a gene's set of
    ancestors and a gene term meets a run's set of ancestors, and both are reduced by
    ``max`` first.

    With ``dropped`` (run_id, hpo_id) there is also ``score_without``, the score without
    those terms, from the same pass: a patient term adds its own match or not, and a
    gene term keeps next to its best ancestor the best one that another term shares.
    """
    patient = patient_terms.select("run_id", F.col("hpo_id").alias("term")).distinct()
    if dropped is None:
        patient = patient.withColumn("_rest", F.lit(True))
    else:
        gone = dropped.select("run_id", F.col("hpo_id").alias("term"), F.lit(False).alias("_kept")).distinct()
        patient = patient.join(gone, ["run_id", "term"], "left").select("run_id", "term", F.coalesce("_kept", F.lit(True)).alias("_rest"))
    wanted = materialize(genes.select("run_id", F.upper("gene").alias("gene")).distinct())
    assoc = materialize(_associated(wanted, associations))
    rows = assoc.groupBy("gene").agg(
        F.count(F.lit(1)).alias("association_count"),
        F.countDistinct("term").alias("_terms"),
    )
    gene_terms = assoc.distinct()
    sizes = patient.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("_patient_terms"), F.count_if("_rest").alias("_patient_rest")
    )

    # the ancestors of the patients' terms are few beside those of all terms, and no other one can be shared
    patient = materialize(patient)
    patient_reach = materialize(ancestors.join(checked_broadcast(patient), "term"))
    term_reach = checked_broadcast(materialize(patient_reach.select(F.col("term").alias("_patient_term"), "ancestor").distinct()))
    run_reach = checked_broadcast(
        materialize(
            patient_reach.groupBy("run_id", "ancestor").agg(F.max("sim").alias("_run_sim"), F.bool_or("_rest").alias("_rest"))
        )
    )
    shared = checked_broadcast(materialize(patient_reach.select("ancestor").distinct()))
    reach, _ = written(
        ancestors.join(shared, "ancestor", "left_semi").join(gene_terms.select("term").distinct(), "term", "left_semi"), "reach"
    )

    gene_reach = gene_terms.join(reach, "term").groupBy("gene", "ancestor").agg(F.max("sim").alias("sim"))
    best_per_patient_term = (
        gene_reach.join(term_reach, "ancestor").groupBy(F.col("_patient_term").alias("term"), "gene").agg(F.max("sim").alias("sim"))
    )
    from_patient = (
        best_per_patient_term.join(checked_broadcast(patient), "term")
        .groupBy("run_id", "gene")
        .agg(F.sum("sim").alias("_from_patient"), F.sum(F.when(F.col("_rest"), F.col("sim"))).alias("_patient_without"))
    )

    from_gene = (
        reach.select("term", "ancestor").join(run_reach, "ancestor")
        .groupBy("run_id", "term")
        .agg(F.max("_run_sim").alias("sim"), F.max(F.when(F.col("_rest"), F.col("_run_sim"))).alias("_sim_rest"))
        .join(gene_terms, "term")
        .groupBy("run_id", "gene")
        .agg(F.sum("sim").alias("_from_gene"), F.sum("_sim_rest").alias("_gene_without"))
    )
    matched = _matched(patient, assoc)

    def average(from_run: str, of_gene: str, terms: str):
        total = F.coalesce(from_run, dbl(0)) + F.coalesce(of_gene, dbl(0))
        scored = (F.col("_terms") > 0) & (F.col(terms) > 0)
        return score_round(F.when(scored, total / (F.col("_terms") + F.col(terms)).cast("double")).otherwise(dbl(0)))

    none = F.array().cast("array<string>")
    scores = [average("_from_patient", "_from_gene", "_patient_terms").alias("score")]
    if dropped is not None:
        scores.append(average("_patient_without", "_gene_without", "_patient_rest").alias("score_without"))
    return (
        wanted.join(rows, "gene", "left")
        .join(sizes, "run_id", "left")
        .join(from_patient, ["run_id", "gene"], "left")
        .join(from_gene, ["run_id", "gene"], "left")
        .join(matched, ["run_id", "gene"], "left")
        .select(
            "run_id",
            "gene",
            *scores,
            F.coalesce("association_count", F.lit(0)).alias("association_count"),
            (F.coalesce("association_count", F.lit(0)) > 0).alias("known"),
            F.coalesce("matched_terms", none).alias("matched_terms"),
            F.coalesce("_patient_terms", F.lit(0)).alias("patient_term_count"),
        )
    )


def unmatched_terms(scores: DataFrame, patient_terms: DataFrame) -> DataFrame:
    """Add ``unmatched_terms``: the run's terms the gene is not annotated with."""
    lists = patient_terms.groupBy("run_id").agg(
        F.array_sort(F.collect_set("hpo_id")).alias("_all")
    )
    return scores.join(lists, "run_id", "left").withColumn(
        "unmatched_terms", F.array_except("_all", "matched_terms")
    ).drop("_all")


def require_dag(terms: DataFrame) -> None:
    if cyclic_terms(terms).limit(1).count():
        raise DataCheckError("cycle in the graph")
