"""Stand-in inputs that need more than one derived table, and their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.operators import inheritance as I
from varloom.operators import ontology as O
from workload import tables as T

def terms(spark, sf) -> DataFrame:
    """Ontology terms with their parents array."""
    parents = (
        T.derived(spark, sf, "parents")
        .groupBy(F.col("child").alias("k"))
        .agg(F.array_sort(F.collect_list(_id("parent"))).alias("parents"))
    )
    return (
        T.derived(spark, sf, "terms")
        .join(parents, "k", "left")
        .withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))
    )


def _id(column: str):
    return F.concat(F.lit("HP:"), F.lpad(F.col(column).cast("string"), 7, "0"))


def associations(spark, sf) -> DataFrame:
    return T.derived(spark, sf, "associations").withColumn("hpo_id", _id("k"))


def patient_terms(spark, sf) -> DataFrame:
    return T.derived(spark, sf, "patient_terms").select(
        "run_id", F.col("j").alias("position"), _id("k").alias("hpo_id")
    )


def closure(spark, sf) -> DataFrame:
    return T.once(spark, sf, "closure", lambda: O.closure(terms(spark, sf)))


def usable_associations(spark, sf) -> DataFrame:
    return O.resolve_associations(associations(spark, sf), terms(spark, sf))


def ancestors(spark, sf) -> DataFrame:
    """Informative ancestors of every term with their scaled information content."""

    def build():
        closed = closure(spark, sf)
        ic = O.information_content(usable_associations(spark, sf), closed)
        return O.informative_ancestors(closed, ic)

    return T.once(spark, sf, "ancestors", build)


def gene_scores(spark, sf) -> DataFrame:
    """Saved score of every gene of a run; features and gene evidence both read it."""

    def build():
        genes = T.variants(spark, sf).where("gene is not null").select("run_id", "gene")
        return O.phenotype_scores(
            patient_terms(spark, sf), genes, usable_associations(spark, sf), ancestors(spark, sf)
        )

    return T.once(spark, sf, "gene_scores", build)


def pedigree(spark, sf) -> DataFrame:
    return I.pedigree_table(T.individuals(spark, sf), T.roles(spark, sf))


def trio(spark, sf) -> DataFrame:
    return I.with_trio(T.variants(spark, sf), pedigree(spark, sf))


# --- SQL forms --------------------------------------------------------------

CLOSURE_SQL = """
closure(term, ancestor) AS (
  SELECT k, k FROM terms
  UNION
  SELECT c.term, p.parent FROM closure c JOIN parents p ON p.child = c.ancestor)"""

USABLE_SQL = """
usable AS (
  SELECT a.gene, coalesce(CAST(substr(t.replaced_by, 4) AS BIGINT), a.k) AS k, a.disease_id, a.evidence
  FROM associations a LEFT JOIN terms t ON t.k = a.k AND t.obsolete AND t.replaced_by IS NOT NULL
  WHERE a.qualifier IS DISTINCT FROM 'NOT')"""

IC_SQL = """
total AS (SELECT greatest(1, count(DISTINCT gene)) AS n FROM usable),
ic AS (
  SELECT c.ancestor AS term, count(DISTINCT u.gene) AS genes,
    -ln((count(DISTINCT u.gene) + 1)::DOUBLE / ((SELECT n FROM total) + 1)::DOUBLE) AS ic
  FROM usable u JOIN closure c ON c.term = u.k GROUP BY c.ancestor),
reach AS (
  SELECT c.term, c.ancestor, least(1.0::DOUBLE, i.ic / (SELECT max(ic) FROM ic)) AS sim
  FROM closure c JOIN ic i ON i.term = c.ancestor WHERE i.ic > 0)"""

SCORES_SQL = """
gene_terms AS (SELECT DISTINCT gene, k FROM usable),
gene_rows AS (SELECT gene, count(*) AS association_count, count(DISTINCT k) AS n_terms FROM usable GROUP BY gene),
patient AS (SELECT DISTINCT run_id, k FROM patient_terms),
pair_sim AS (
  SELECT a.term AS p, b.term AS t, max(a.sim) AS sim
  FROM (SELECT r.* FROM reach r WHERE r.term IN (SELECT k FROM patient)) a
  JOIN (SELECT r.* FROM reach r WHERE r.term IN (SELECT k FROM gene_terms)) b USING (ancestor)
  GROUP BY a.term, b.term),
best_p AS (
  SELECT p.run_id, g.gene, p.k, max(coalesce(s.sim, 0)) AS sim
  FROM patient p CROSS JOIN gene_terms g LEFT JOIN pair_sim s ON s.p = p.k AND s.t = g.k
  GROUP BY ALL),
best_g AS (
  SELECT p.run_id, g.gene, g.k, max(coalesce(s.sim, 0)) AS sim
  FROM patient p CROSS JOIN gene_terms g LEFT JOIN pair_sim s ON s.p = p.k AND s.t = g.k
  GROUP BY ALL),
sums AS (
  SELECT run_id, gene, sum(sim) AS total, count(*) AS n
  FROM (SELECT * FROM best_p UNION ALL SELECT * FROM best_g) GROUP BY run_id, gene),
matched AS (
  SELECT p.run_id, g.gene, count(*) AS n FROM patient p JOIN gene_terms g USING (k) GROUP BY ALL),
wanted AS (SELECT DISTINCT run_id, upper(gene) AS gene FROM variants WHERE gene IS NOT NULL),
scores AS (
  SELECT w.run_id, w.gene, round(coalesce(s.total / s.n, 0) + 1e-9, 6) AS score,
    coalesce(r.association_count, 0) AS association_count,
    coalesce(r.association_count, 0) > 0 AS known, coalesce(m.n, 0) AS matched
  FROM wanted w LEFT JOIN sums s USING (run_id, gene) LEFT JOIN gene_rows r USING (gene)
  LEFT JOIN matched m USING (run_id, gene))"""

PHENO_TABLES = ("variants", "terms", "parents", "associations", "patient_terms")
PHENO_SQL = ",".join((CLOSURE_SQL, USABLE_SQL, IC_SQL, SCORES_SQL))


def _called(x: str) -> str:
    return f"({x} IS NOT NULL AND {x} <> './.')"


def _ok(gt: str, gq: str, vaf: str | None = None) -> str:
    low = f"coalesce({gq} < 20, false)"
    if vaf:
        low += f" OR ({gt} NOT IN ('0/0') AND coalesce({vaf} < 0.25, false))"
    return f"NOT ({_called(gt)} AND ({low}))"


# one row per variant with the trio facts; genotypes here are one- or two-token calls
TRIO_SQL = f"""
trio AS (
  SELECT v.*, p.p_affected, p.m_affected, p.f_affected, p.p_sex,
    genotype <> '0/0' AS p_alt, genotype IN ('0/1', '0|1', '1|0') AS p_het,
    m_gt <> './.' AS m_called, m_gt IN ('0/1', '1/1') AS m_alt, m_gt = '0/0' AS m_ref, m_gt = '0/1' AS m_het,
    f_gt <> './.' AS f_called, f_gt IN ('0/1', '1/1') AS f_alt, f_gt = '0/0' AS f_ref, f_gt = '0/1' AS f_het,
    ({_ok('genotype', 'p_gq', 'p_vaf')}) AND ({_ok('m_gt', 'm_gq')}) AND ({_ok('f_gt', 'f_gq')}) AS q
  FROM variants v JOIN pedigree p USING (run_id)),
facts AS (
  SELECT *,
    (p_affected IS NOT NULL)::INT + (m_affected IS NOT NULL AND m_called)::INT
      + (f_affected IS NOT NULL AND f_called)::INT AS informative,
    coalesce(p_affected AND p_alt, false)::INT
      + coalesce(m_called AND CASE WHEN m_affected THEN m_alt ELSE m_ref END AND m_affected IS NOT NULL, false)::INT
      + coalesce(f_called AND CASE WHEN f_affected THEN f_alt ELSE f_ref END AND f_affected IS NOT NULL, false)::INT AS consistent,
    coalesce(m_affected AND m_alt, false) OR coalesce(f_affected AND f_alt, false) AS carrier,
    CASE WHEN NOT (m_called AND f_called) THEN 'unknown' WHEN m_alt AND f_ref THEN 'maternal'
         WHEN f_alt AND m_ref THEN 'paternal' ELSE 'unknown' END AS origin
  FROM trio),
raw_fits AS (
  SELECT *,
    CASE WHEN NOT p_alt THEN 0 WHEN NOT (m_called AND f_called) THEN 0.4
         WHEN m_ref AND f_ref THEN 1 ELSE 0 END AS r_dn,
    CASE WHEN NOT p_alt THEN 0 ELSE
      CASE WHEN carrier OR (m_ref AND f_ref)
        THEN CASE WHEN informative > 0 THEN consistent::DOUBLE / informative ELSE 0.5 END
        ELSE least(0.5, CASE WHEN informative > 0 THEN consistent::DOUBLE / informative ELSE 0.5 END) END END AS r_ad,
    CASE WHEN genotype <> '1/1' THEN 0 WHEN NOT (m_called AND f_called) THEN 0.65
         WHEN m_het AND f_het THEN 1 ELSE 0.35 END AS r_hr,
    CASE WHEN chromosome <> 'X' THEN 0 WHEN p_sex <> 'male' THEN 0.2 WHEN NOT p_alt THEN 0
         WHEN m_het THEN CASE WHEN f_ref THEN 1 ELSE 0.9 END ELSE 0.55 END AS r_xl
  FROM facts),
fits AS (
  SELECT *,
    round(CASE WHEN q AND p_affected IS NOT NULL THEN r_dn ELSE least(r_dn, 0.5) END::DOUBLE, 4) AS de_novo,
    round(CASE WHEN q AND p_affected IS NOT NULL THEN r_ad ELSE least(r_ad, 0.5) END::DOUBLE, 4) AS autosomal_dominant,
    round(CASE WHEN q AND p_affected IS NOT NULL THEN r_hr ELSE least(r_hr, 0.5) END::DOUBLE, 4) AS homozygous_recessive,
    round(CASE WHEN q AND p_affected IS NOT NULL THEN r_xl ELSE least(r_xl, 0.5) END::DOUBLE, 4) AS x_linked
  FROM raw_fits)"""

PAIRS_SQL = """
cand AS (
  SELECT * FROM fits WHERE genotype IN ('0/1', '1/0', '0|1', '1|0') AND p_het AND chromosome IS NOT NULL
    AND upper(trim(gene)) NOT IN ('', '.', 'UNKNOWN', 'UNASSIGNED')),
pairs AS (
  SELECT a.run_id, a.variant_id AS variant_a, b.variant_id AS variant_b, a.row_id AS row_a, b.row_id AS row_b,
    upper(trim(a.gene)) AS gene, a.chromosome, a.q AS q_a, b.q AS q_b, a.p_affected,
    CASE WHEN a.origin <> 'unknown' AND b.origin <> 'unknown' AND a.origin <> b.origin
           THEN CASE WHEN a.q AND b.q THEN 'confirmed_trans' ELSE 'possible_trans' END
         WHEN a.origin <> 'unknown' AND b.origin <> 'unknown' THEN 'unknown'
         WHEN a.origin <> 'unknown' OR b.origin <> 'unknown' THEN 'possible_trans'
         WHEN contains(a.genotype, '|') AND contains(b.genotype, '|') AND a.genotype <> b.genotype THEN 'possible_trans'
         ELSE 'unknown' END AS phase,
    (CASE WHEN a.origin <> 'unknown' AND b.origin <> 'unknown' AND a.origin <> b.origin
           THEN CASE WHEN a.q AND b.q THEN 0.95 ELSE 0.5 END
         WHEN a.origin <> 'unknown' AND b.origin <> 'unknown' THEN 0.25
         WHEN a.origin <> 'unknown' OR b.origin <> 'unknown' THEN 0.65
         WHEN contains(a.genotype, '|') AND contains(b.genotype, '|') AND a.genotype <> b.genotype THEN 0.7
         ELSE 0.55 END)::DOUBLE AS confidence
  FROM cand a JOIN cand b ON a.run_id = b.run_id AND upper(a.gene) = upper(b.gene)
    AND a.chromosome = b.chromosome AND a.row_id < b.row_id),
ends AS (
  SELECT run_id, variant_a AS variant_id, variant_b AS partner, row_b AS partner_row, phase,
    CASE WHEN q_a AND p_affected IS NOT NULL THEN confidence ELSE least(confidence, 0.5) END AS score FROM pairs
  UNION ALL
  SELECT run_id, variant_b, variant_a, row_a, phase,
    CASE WHEN q_b AND p_affected IS NOT NULL THEN confidence ELSE least(confidence, 0.5) END FROM pairs),
compound AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, variant_id
    ORDER BY score DESC, partner_row DESC) AS n FROM ends) WHERE n = 1),
models AS (
  SELECT f.*, c.score AS compound_heterozygous, c.partner, c.phase,
    greatest(f.homozygous_recessive, coalesce(c.score, 0)) AS autosomal_recessive
  FROM fits f LEFT JOIN compound c USING (run_id, variant_id))"""
