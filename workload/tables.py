"""Stand-in inputs derived from the supplied tables.

The supplied tables hold no variants, so the inputs of the operators are derived
with integer arithmetic and CASE only. The text is shared by both engines: in
Spark it runs over the Parquet scans, in the SQL check it becomes a CTE.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions import genotype as G
from varloom.session import ensure_checkpoint_dir

SOURCE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

CONSEQUENCES = (
    "transcript_ablation",
    "stop_gained",
    "frameshift_variant",
    "splice_acceptor_variant",
    "splice_donor_variant",
    "start_lost",
    "stop_lost",
    "missense_variant",
    "inframe_insertion",
    "inframe_deletion",
    "synonymous_variant",
    "intron_variant",
    "intergenic_variant",
)
CLINVAR = (
    "Pathogenic",
    "Likely_pathogenic",
    "Conflicting_interpretations_of_pathogenicity",
    "Benign",
    "Uncertain_significance",
)


def _case(expr: str, values, start: int = 0) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values, start))
    return f"CASE {expr} {whens} END"


def _gt(expr: str) -> str:
    return _case(expr, ("0/1", "0/0", "1/1", "./."))


def _gq(expr: str, row: str) -> str:
    return f"CASE WHEN {row} % 29 = 0 THEN NULL ELSE CAST({expr} AS DOUBLE) END"


# name -> SQL; {div} is the integer division of the engine, [name] another derived table
DERIVED = {
    "base": """
SELECT l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln, min(l_partkey) AS pk,
       max(l_quantity) AS q
FROM lineitem GROUP BY l_orderkey, CAST(l_linenumber AS BIGINT)""",
    "keyed": """
SELECT ok, ln, pk, q, ok * 10 + ln AS row_id, pk {div} 5 AS g FROM [base]""",
    "variants": f"""
SELECT row_id, ok, ln, pk,
  concat('run', CAST(ok % 8 AS STRING)) AS run_id,
  concat('v', CAST(row_id AS STRING)) AS variant_id,
  CASE WHEN g % 17 = 0 THEN NULL WHEN g % 19 = 0 THEN 'UNKNOWN'
       ELSE concat('G', CAST(g AS STRING)) END AS gene,
  CASE WHEN g % 23 = 22 THEN 'X' ELSE CAST(g % 23 + 1 AS STRING) END AS chromosome,
  row_id AS position,
  {_case('row_id % 4', 'ACGT')} AS reference,
  {_case('row_id % 4', 'CGTA')} AS alternate,
  CASE WHEN row_id % 23 = 0 THEN NULL ELSE CAST(q * 2 AS DOUBLE) END AS quality,
  CASE WHEN row_id % 13 = 0 THEN NULL
       ELSE CAST((row_id * 31) % 1000 AS DOUBLE) / CAST(50000 AS DOUBLE) END AS allele_frequency,
  {_case('row_id % 14', CONSEQUENCES)} AS consequence,
  {_case('row_id % 11', CLINVAR)} AS clinvar_classification,
  CAST(row_id % 40 AS DOUBLE) AS cadd_score,
  CASE row_id % 3 WHEN 0 THEN CASE (row_id {{div}} 3) % 5 WHEN 0 THEN '0|1' WHEN 1 THEN '1|0'
       ELSE '0/1' END WHEN 1 THEN '1/1' ELSE '0/0' END AS genotype,
  {_gt('(row_id {div} 3) % 4')} AS m_gt,
  {_gt('(row_id {div} 12) % 4')} AS f_gt,
  {_gq('row_id % 60', 'row_id')} AS p_gq,
  {_gq('(row_id {div} 5) % 60 + 10', 'row_id')} AS m_gq,
  {_gq('(row_id {div} 7) % 60 + 10', 'row_id')} AS f_gq,
  CASE WHEN row_id % 7 = 0 THEN CAST(row_id % 100 AS DOUBLE) / CAST(100 AS DOUBLE) END AS p_vaf
FROM [keyed]""",
    "runs": """
SELECT r, concat('run', CAST(r AS STRING)) AS run_id
FROM (SELECT DISTINCT o_orderkey % 8 AS r FROM orders) d""",
    "pedigree": """
SELECT run_id, r, CASE WHEN r % 4 = 3 THEN NULL ELSE 1 = 1 END AS p_affected,
  r % 3 = 0 AS m_affected,
  CASE WHEN r % 5 = 4 THEN NULL ELSE 1 = 0 END AS f_affected,
  CASE WHEN r % 2 = 0 THEN 'male' ELSE 'female' END AS p_sex
FROM [runs]""",
    "terms": """
SELECT p_partkey AS k, concat('HP:', lpad(CAST(p_partkey AS STRING), 7, '0')) AS hpo_id,
  p_name AS label, p_partkey % 50 = 49 AS obsolete,
  CASE WHEN p_partkey % 50 = 49 AND p_partkey % 100 <> 99
       THEN concat('HP:', lpad(CAST(p_partkey - 1 AS STRING), 7, '0')) END AS replaced_by
FROM (SELECT p_partkey + 1 AS p_partkey, p_name FROM part) shifted""",
    "parents": """
SELECT p_partkey AS child, p_partkey {div} 2 AS parent
FROM (SELECT p_partkey + 1 AS p_partkey FROM part) shifted WHERE p_partkey >= 2
UNION ALL
SELECT p_partkey AS child, p_partkey {div} 3 AS parent FROM (SELECT p_partkey + 1 AS p_partkey FROM part) shifted
WHERE p_partkey >= 3 AND p_partkey % 3 = 0 AND p_partkey {div} 3 <> p_partkey {div} 2""",
    "associations": """
SELECT concat('G', CAST(p_partkey {div} 5 AS STRING)) AS gene, p_partkey AS k,
  CASE WHEN p_partkey % 31 = 0 THEN 'NOT' END AS qualifier,
  concat('D:', CAST(p_partkey % 97 AS STRING)) AS disease_id, p_type AS evidence
FROM (SELECT p_partkey + 1 AS p_partkey, p_type FROM part) shifted""",
    "patient_terms": """
SELECT run_id, j, (r * 37 + j * 101) % n + 1 AS k
FROM [runs] CROSS JOIN (SELECT count(*) AS n FROM part) c
CROSS JOIN (SELECT CAST(0 AS BIGINT) AS j UNION ALL SELECT 1 UNION ALL SELECT 2
            UNION ALL SELECT 3 UNION ALL SELECT 4) js""",
}


def _names_in(text: str) -> list[str]:
    return re.findall(r"\[(\w+)\]", text)


def _expand(name: str, seen: list[str]) -> None:
    for inner in _names_in(DERIVED[name]):
        _expand(inner, seen)
    if name not in seen:
        seen.append(name)


def duckdb_with(*names: str) -> str:
    """``WITH`` text defining the derived tables (and what they need) for the SQL check."""
    order: list[str] = []
    for name in names:
        _expand(name, order)
    parts = []
    for name in order:
        body = re.sub(r"\[(\w+)\]", r"\1", DERIVED[name].replace("{div}", "//"))
        parts.append(f"{name} AS ({body.replace('AS STRING', 'AS VARCHAR')})")
    return ",\n".join(parts)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Derived table as a lazy DataFrame over the Parquet scans."""
    text = DERIVED[name].replace("{div}", "div")
    frames = {inner: derived(spark, sf_dir, inner) for inner in set(_names_in(text))}
    text = re.sub(r"\[(\w+)\]", r"{\1}", text)
    for table in SOURCE_TABLES:
        pattern = rf"\b(FROM|JOIN) {table}\b"
        if re.search(pattern, text):
            frames[table] = read(spark, sf_dir, table)
            text = re.sub(pattern, rf"\1 {{{table}}}", text)
    return spark.sql(text, **frames)


_WRITTEN: dict[tuple, str] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived table written once per session as Parquet in the shared folder.

    Queries then scan it like any saved table (column pruning and pushed
    filters included) instead of deriving it again.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        build().write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant rows with the typed call map."""
    return once(spark, sf_dir, "variants", lambda: _variants(spark, sf_dir))


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = derived(spark, sf_dir, "variants")
    calls = F.create_map(
        F.lit("P"),
        G.call_struct(F.col("genotype"), F.col("p_gq"), F.col("p_vaf")),
        F.lit("M"),
        G.call_struct(F.col("m_gt"), F.col("m_gq"), F.lit(None)),
        F.lit("F"),
        G.call_struct(F.col("f_gt"), F.col("f_gq"), F.lit(None)),
    )
    return flat.withColumn("calls", calls)


def individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ped = derived(spark, sf_dir, "pedigree")

    def person(name, sex, affected):
        return F.struct(F.lit(name).alias("id"), sex.alias("sex"), affected.alias("affected"))

    people = F.array(
        person("P", F.col("p_sex"), F.col("p_affected")),
        person("M", F.lit("female"), F.col("m_affected")),
        person("F", F.lit("male"), F.col("f_affected")),
    )
    is_proband = F.col("id") == "P"
    return (
        ped.select("run_id", F.explode(people).alias("x"))
        .select("run_id", "x.*")
        .withColumn("mother_id", F.when(is_proband, F.lit("M")))
        .withColumn("father_id", F.when(is_proband, F.lit("F")))
    )


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "pedigree").select(
        "run_id",
        F.lit("P").alias("proband_id"),
        F.lit("M").alias("mother_id"),
        F.lit("F").alias("father_id"),
    )
