"""Sources and sinks (inventory A and B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom import constants as K
from varloom.functions.sensitive import extract_ids
from varloom.operators import quality as Q
from varloom.operators import annotate as A
from varloom.operators import ranking as R
from varloom.operators import branches as B
from varloom.operators.evidence import inheritance_evidence
from varloom.operators import inheritance as I
from varloom.session import materialize
from varloom.sinks import writers as W
from varloom.sources import tables as ST
from varloom.sources import vcf as V
from workload import shared as S
from workload import tables as T
from workload import text as X
from workload.registry import query, scratch, with_tables

ZYGOSITY = (
    "CASE WHEN genotype IN ('0/1', '0|1', '1|0') THEN 'heterozygous' "
    "WHEN genotype = '1/1' THEN 'homozygous_alternate' ELSE 'reference' END"
)
CHROM = "concat(CASE WHEN row_id % 2 = 0 THEN 'chr' ELSE '' END, chromosome)"

ALLELES_SQL = f"""
alleles AS (
  SELECT v.*, a.i AS alt_index, CASE WHEN a.i = 0 THEN alternate ELSE 'T' || alternate END AS alt,
    CASE WHEN row_id % 5 = 0 THEN 2 ELSE 1 END AS n_alt, {CHROM} AS chrom
  FROM variants v JOIN (SELECT 0 AS i UNION ALL SELECT 1) a ON a.i = 0 OR v.row_id % 5 = 0)"""


@query(
    "a01_vcf_text_scan",
    with_tables(
        "variants",
        extra=ALLELES_SQL,
        body=f"""
SELECT run_id || '.vcf' AS path, chromosome, position, reference, alt AS alternate,
  CASE WHEN row_id % 3 = 0 THEN chrom || '-' || position || '-' || reference || '-' || alt
       WHEN n_alt > 1 THEN variant_id || ':' || alt ELSE variant_id END AS variant_id,
  gene, consequence, clinvar_classification, quality,
  CASE WHEN alt_index = 1 AND allele_frequency IS NOT NULL THEN 0.5::DOUBLE
       WHEN n_alt = 1 OR alt_index = 0 THEN allele_frequency END AS allele_frequency,
  cadd_score, genotype, {ZYGOSITY} AS zygosity, p_gq, p_vaf, m_gt, f_gq
FROM alleles""",
    ),
)
def vcf_text_scan(spark, sf):
    """One block-compressed file per run, several splits each."""
    rows = V.read_vcf(spark, X.vcf_files(spark, sf), block_compressed=True, split_bytes=X.SPLIT)
    rows = rows.withColumn("path", X.file_name())
    call = lambda s, f: F.col("calls")[s][f]
    return rows.select(
        "path",
        "chromosome",
        "position",
        "reference",
        "alternate",
        "variant_id",
        "gene",
        "consequence",
        "clinvar_classification",
        "quality",
        "allele_frequency",
        "cadd_score",
        "genotype",
        "zygosity",
        call("P", "quality").alias("p_gq"),
        call("P", "alternate_fraction").alias("p_vaf"),
        call("M", "genotype").alias("m_gt"),
        call("F", "quality").alias("f_gq"),
    )


@query(
    "a02_vcf_samples",
    with_tables(
        "runs",
        body="""SELECT run_id || '.vcf' AS path, CAST(i AS BIGINT) AS idx, s AS sample
FROM runs CROSS JOIN (SELECT 0 AS i, 'P' AS s UNION ALL SELECT 1, 'M' UNION ALL SELECT 2, 'F') x""",
    ),
)
def vcf_samples(spark, sf):
    return V.vcf_samples(X.vcf_lines(spark, sf)).withColumn("idx", F.col("idx").cast("bigint"))


@query(
    "a02_vcf_header_checks",
    with_tables(
        "runs",
        body="SELECT run_id || '.vcf' AS path, CASE WHEN r % 2 = 0 THEN 'missing_header' ELSE 'record_before_header' END AS reason FROM runs",
    ),
)
def vcf_header_checks(spark, sf):
    """Even runs lose their header line, odd runs get it after the records."""
    lines = X.vcf_lines(spark, sf)
    header = F.col("value").startswith("#CHROM")
    even = F.regexp_extract("path", r"run(\d+)", 1).cast("int") % 2 == 0
    moved = lines.where(~(header & even)).withColumn(
        "line_no", F.when(header, F.lit(1 << 40)).otherwise(F.col("line_no"))
    )
    return V.header_violations(moved)


@query(
    "a03_line_length_guard",
    """SELECT source AS path, doc_id AS line_no, CAST(length(text) AS BIGINT) AS n
FROM documents WHERE length(text) > 5000""",
)
def line_length_guard(spark, sf):
    docs = T.read(spark, sf, "documents").select(
        F.col("source").alias("path"), F.col("doc_id").alias("line_no"), F.col("text").alias("value")
    )
    return V.long_lines(docs, 5000).withColumn("n", F.col("n").cast("bigint"))


@query(
    "a04_ontology_scan",
    with_tables(
        "terms",
        "parents",
        body="""
SELECT t.hpo_id, t.label, coalesce(string_agg('HP:' || lpad(CAST(p.parent AS VARCHAR), 7, '0'), ',' ORDER BY p.parent), '') AS parents,
  t.obsolete, t.replaced_by
FROM terms t LEFT JOIN parents p ON p.child = t.k GROUP BY ALL""",
    ),
)
def ontology_scan(spark, sf):
    """Read from files; a term lies whole in one of them."""
    return ST.read_obo(spark, X.obo_files(spark, sf)).withColumn("parents", F.array_join("parents", ","))


@query(
    "a05_association_scan",
    with_tables(
        "associations",
        body="""SELECT gene, 'HP:' || lpad(CAST(k AS VARCHAR), 7, '0') AS hpo_id, disease_id, evidence
FROM associations""",
    ),
)
def association_scan(spark, sf):
    """Read from files: every part has a header, and two column orders lie in one folder."""
    return ST.read_associations(spark, X.association_files(spark, sf))


@query(
    "a06_official_association_scan",
    with_tables(
        "associations",
        body="""SELECT gene, 'HP:' || lpad(CAST(k AS VARCHAR), 7, '0') AS hpo_id, disease_id, evidence, qualifier,
  CAST(k AS VARCHAR) AS ncbi_gene_id, 'r1' AS release, 'lic' AS license_reference, 'c0' AS source_checksum
FROM associations""",
    ),
)
def official_association_scan(spark, sf):
    rows = ST.read_hpo_annotations(spark, X.official_files(spark, sf), "genes", "r1", "lic", "c0")
    return rows.select(
        "gene", "hpo_id", "disease_id", "evidence", "qualifier", "ncbi_gene_id", "release",
        "license_reference", "source_checksum",
    )


SAVED_SQL = with_tables(
    "variants",
    body="""SELECT chromosome, position, reference, alternate, variant_id, gene, consequence, genotype, quality,
  allele_frequency, clinvar_classification, cadd_score, m_gt, p_gq FROM variants""",
)


def _saved_columns(df):
    return df.select(
        "chromosome", "position", "reference", "alternate", "variant_id", "gene", "consequence", "genotype",
        "quality", "allele_frequency", "clinvar_classification", "cadd_score",
        F.col("calls")["M"]["genotype"].alias("m_gt"), F.col("calls")["P"]["quality"].alias("p_gq"),
    )


@query("a07_parquet_variant_scan", SAVED_SQL)
def parquet_variant_scan(spark, sf):
    """Reads the saved table by its fixed schema (written first, as no saved table is supplied)."""
    path = scratch(spark, "variants")
    W.write_variants(T.variants(spark, sf), path)
    return _saved_columns(ST.read_variants(spark, path))


@query("b01_variant_parquet_sink", with_tables(
    "variants",
    body="""SELECT chromosome, count(*) AS n, sum(position) AS positions, count(genotype) AS genotypes,
  count(*) FILTER (WHERE allele_frequency IS NULL) AS missing_af FROM variants GROUP BY chromosome""",
))
def variant_parquet_sink(spark, sf):
    path = scratch(spark, "variants")
    written = W.write_variants(T.variants(spark, sf), path)
    saved = spark.read.parquet(path)
    if saved.count() != written:
        raise ValueError("written and read row counts differ")
    return saved.groupBy("chromosome").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("position").alias("positions"),
        F.count("genotype").alias("genotypes"),
        F.count_if(F.col("allele_frequency").isNull()).alias("missing_af"),
    )


TRUTH_ROWS_SQL = """
labels_ AS (
  SELECT run_id, min(row_id) AS row_id FROM variants
  WHERE gene IS NOT NULL AND gene <> 'UNKNOWN' GROUP BY run_id),
truth AS (
  SELECT v.run_id, 'case_' || v.run_id AS case_id, v.variant_id, v.gene, v.row_id, v.pk
  FROM variants v JOIN labels_ l USING (run_id, row_id))"""


def truth_rows(spark, sf):
    """Per run the labelled variant: the first with a known gene."""
    v = T.variants(spark, sf).where("gene is not null and gene <> 'UNKNOWN'")
    return v.groupBy("run_id").agg(
        F.min_by(F.struct("variant_id", "gene", "row_id", "pk"), "row_id").alias("t")
    ).select("run_id", F.concat(F.lit("case_"), "run_id").alias("case_id"), "t.*")


@query(
    "a08_truth_label_scan",
    with_tables(
        "variants",
        extra=TRUTH_ROWS_SQL,
        body="""SELECT case_id, run_id, gene AS expected_gene_id, row_id AS source_row, CAST(1 AS BIGINT) AS source_alt FROM truth""",
    ),
)
def truth_label_scan(spark, sf):
    path = scratch(spark, "truth")
    truth_rows(spark, sf).select(
        "case_id",
        "run_id",
        F.sha2("case_id", 256).alias("source_sha256"),
        F.lit("review").alias("truth_reference"),
        F.col("gene").alias("expected_gene_id"),
        F.array(F.struct(F.col("row_id").alias("source_row"), F.lit(1).alias("source_alt"))).alias("alleles"),
    ).write.json(path)
    return ST.read_truth(spark, path).select(
        "case_id",
        "run_id",
        "expected_gene_id",
        F.col("alleles")[0]["source_row"].alias("source_row"),
        F.col("alleles")[0]["source_alt"].cast("bigint").alias("source_alt"),
    )


@query(
    "a09_reference_list_scan",
    """SELECT s_suppkey + 1 AS shard, 'shard_' || s_suppkey AS directory, s_name AS integrity_sha256 FROM supplier""",
)
def reference_list_scan(spark, sf):
    path = scratch(spark, "references")
    T.read(spark, sf, "supplier").select(
        (F.col("s_suppkey") + 1).alias("shard"),
        F.concat(F.lit("shard_"), F.col("s_suppkey").cast("string")).alias("directory"),
        F.col("s_name").alias("integrity_sha256"),
    ).write.json(path)
    return ST.read_reference_list(spark, path)


@query(
    "a09_reference_list_checks",
    """WITH l AS (SELECT s_suppkey % 90 AS shard, 'd' || s_suppkey % 95 AS directory, s_suppkey % 7 = 0 AS twice FROM supplier)
SELECT reason, count(*) AS n FROM (
  SELECT 'duplicate_key' AS reason FROM l WHERE twice
  UNION ALL SELECT 'duplicate_shard' FROM l GROUP BY shard HAVING count(*) > 1
  UNION ALL SELECT 'duplicate_directory' FROM l GROUP BY directory HAVING count(*) > 1) GROUP BY reason""",
)
def reference_list_checks(spark, sf):
    s = T.read(spark, sf, "supplier")
    shard = (F.col("s_suppkey") % 90).cast("string")
    value = F.concat(
        F.lit('{"shard": '), shard, F.lit(', "directory": "d'), (F.col("s_suppkey") % 95).cast("string"), F.lit('"'),
        F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit(', "shard": '), shard)).otherwise(""),
        F.lit("}"),
    )
    found = ST.reference_violations(s.select(value.alias("value")))
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


PEOPLE_SQL = """
people AS (
  SELECT 'fam' || (c_custkey % 40) AS run_id, 'p' || CASE WHEN c_custkey % 211 = 0 THEN c_custkey + 40 ELSE c_custkey END AS id,
    CASE WHEN c_custkey % 3 = 0 THEN 'p' || (c_custkey + 40) WHEN c_custkey % 101 = 1 THEN 'p' || c_custkey END AS mother_id,
    CASE WHEN c_custkey % 3 = 0 THEN 'p' || (c_custkey + 80) END AS father_id FROM customer),
roles_ AS (
  SELECT 'fam' || k AS run_id, 'p' || CASE WHEN k % 13 = 0 THEN -1 ELSE k END AS proband_id,
    'p' || (k + 40) AS mother_id, 'p' || (k + CASE WHEN k % 9 = 0 THEN 40 ELSE 80 END) AS father_id
  FROM (SELECT DISTINCT c_custkey % 40 AS k FROM customer)),
links AS (
  SELECT run_id, id AS child, mother_id AS parent FROM people UNION ALL
  SELECT run_id, id, father_id FROM people UNION ALL
  SELECT run_id, proband_id, mother_id FROM roles_ UNION ALL SELECT run_id, proband_id, father_id FROM roles_)"""


def people(spark, sf):
    c = T.read(spark, sf, "customer")
    name = lambda x: F.concat(F.lit("p"), x.cast("string"))
    key = F.col("c_custkey")
    individuals = c.select(
        F.concat(F.lit("fam"), (key % 40).cast("string")).alias("run_id"),
        name(F.when(key % 211 == 0, key + 40).otherwise(key)).alias("id"),
        F.when(key % 3 == 0, name(key + 40)).when(key % 101 == 1, name(key)).alias("mother_id"),
        F.when(key % 3 == 0, name(key + 80)).alias("father_id"),
    )
    k = F.col("k")
    roles = c.select((key % 40).alias("k")).distinct().select(
        F.concat(F.lit("fam"), k.cast("string")).alias("run_id"),
        name(F.when(k % 13 == 0, -1).otherwise(k)).alias("proband_id"),
        name(k + 40).alias("mother_id"),
        name(k + F.when(k % 9 == 0, 40).otherwise(80)).alias("father_id"),
    )
    return individuals, roles


@query(
    "a10_pedigree_checks",
    f"""WITH {PEOPLE_SQL.strip()}
SELECT DISTINCT run_id, reason FROM (
  SELECT run_id, 'duplicate_individual' AS reason FROM people GROUP BY run_id, id HAVING count(*) > 1
  UNION ALL SELECT run_id, 'pedigree_too_large' FROM people GROUP BY run_id HAVING count(*) > 1000
  UNION ALL SELECT run_id, 'unknown_proband' FROM roles_ r WHERE NOT EXISTS
    (SELECT 1 FROM people p WHERE p.run_id = r.run_id AND p.id = r.proband_id)
  UNION ALL SELECT run_id, 'unknown_parent' FROM links l WHERE parent IS NOT NULL AND NOT EXISTS
    (SELECT 1 FROM people p WHERE p.run_id = l.run_id AND p.id = l.parent)
  UNION ALL SELECT run_id, 'self_parent' FROM links WHERE child = parent
  UNION ALL SELECT run_id, 'parents_not_distinct' FROM roles_ WHERE mother_id = father_id)""",
)
def pedigree_checks(spark, sf):
    return Q.pedigree_violations(*people(spark, sf))


@query(
    "a10_pedigree_cycles",
    f"""WITH RECURSIVE {PEOPLE_SQL.strip()},
up(run_id, child, parent) AS (
  SELECT DISTINCT run_id, child, parent FROM links WHERE parent IS NOT NULL
  UNION SELECT u.run_id, u.child, l.parent FROM up u JOIN links l ON l.run_id = u.run_id AND l.child = u.parent
  WHERE l.parent IS NOT NULL)
SELECT DISTINCT run_id, child AS id FROM up WHERE child = parent""",
)
def pedigree_cycles(spark, sf):
    return Q.pedigree_cycles(*people(spark, sf))


@query(
    "a11_term_id_extraction",
    r"""WITH d AS (
  SELECT doc_id, true AS in_table, text || ' HP:' || lpad(CAST(doc_id % 977 AS VARCHAR), 7, '0') || ' HP:0000001'
    || CASE WHEN doc_id % 9 = 0 THEN ' absent' ELSE '' END AS text FROM documents
  UNION ALL
  SELECT doc_id, doc_id % 4 <> 0, 'HP:' || lpad(CAST((doc_id + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END) % 977 AS VARCHAR), 7, '0') FROM documents),
x AS (SELECT doc_id, in_table, regexp_extract_all(text, '\b(HP:[0-9]{7})\b', 1) AS ids,
    regexp_matches(text, '(?i)\b(absent|negative|denied|excluded|not present)\b') AS pol FROM d),
p AS (SELECT doc_id, bool_or(in_table AND len(ids) > 0 AND pol) AS polarity FROM x GROUP BY doc_id),
i AS (SELECT doc_id, id, bool_or(in_table) AS t FROM (SELECT doc_id, in_table, unnest(ids) AS id FROM x) GROUP BY doc_id, id),
c AS (SELECT doc_id, count(*) FILTER (WHERE t) AS table_ids, count(*) AS all_ids FROM i GROUP BY doc_id)
SELECT doc_id, table_ids, all_ids, polarity, NOT polarity AND table_ids = all_ids AND table_ids BETWEEN 1 AND 500 AS ok
FROM p JOIN c USING (doc_id)""",
)
def term_id_extraction(spark, sf):
    d = T.read(spark, sf, "documents")
    pad = lambda x: F.concat(F.lit("HP:"), F.lpad((x % 977).cast("string"), 7, "0"))
    table = d.select(
        "doc_id",
        F.lit(True).alias("in_table"),
        F.concat(
            "text", F.lit(" "), pad(F.col("doc_id")), F.lit(" HP:0000001"),
            F.when(F.col("doc_id") % 9 == 0, " absent").otherwise(""),
        ).alias("text"),
    )
    other = d.select(
        "doc_id",
        (F.col("doc_id") % 4 != 0).alias("in_table"),
        pad(F.col("doc_id") + F.when(F.col("doc_id") % 6 == 0, 1).otherwise(0)).alias("text"),
    )
    return extract_ids(table.unionByName(other), "doc_id")


@query(
    "a12_contig_statistics",
    with_tables(
        "variants",
        body=f"""SELECT run_id || '.vcf' AS path, {CHROM} AS name,
  CAST(CASE WHEN chromosome = 'X' THEN 1000 ELSE CAST(chromosome AS BIGINT) * 1000 END AS BIGINT) AS length,
  count(*) AS records FROM variants GROUP BY ALL""",
    ),
)
def contig_statistics(spark, sf):
    """Read from block-compressed files with the contigs in their headers."""
    contigs = [
        f"##contig=<ID={p}{c},length={1000 if c == 'X' else int(c) * 1000}>"
        for p in ("", "chr")
        for c in (*K.AUTOSOMES, "X")
    ]
    folder = X.vcf_files(spark, sf, [X.HEADER[0], *contigs, X.HEADER[1]])
    lines = V.read_lines(spark, folder, block_compressed=True, split_bytes=X.SPLIT)
    return V.contig_statistics(lines).withColumn("path", X.file_name())


# --- sinks ------------------------------------------------------------------


@query(
    "b04_case_report_sink",
    with_tables(
        "variants",
        extra=TRUTH_ROWS_SQL,
        body="""SELECT case_id, run_id, gene, '[{"source_row":' || row_id || '}]' AS targets FROM truth""",
    ),
)
def case_report_sink(spark, sf):
    path = scratch(spark, "report")
    cases = truth_rows(spark, sf).select(
        "case_id", "run_id", "gene", F.array(F.struct(F.col("row_id").alias("source_row"))).alias("targets")
    )
    W.write_case_report(cases, cases.agg(F.count(F.lit(1)).alias("cases")), path)
    schema = "case_id string, run_id string, gene string, targets string"
    return spark.read.csv(f"{path}/cases", sep="\t", header=True, quote="", schema=schema)


@query(
    "b06_manifest_and_verify",
    """SELECT DISTINCT o_orderpriority AS subject, CASE o_orderpriority WHEN '1-URGENT' THEN 'missing' ELSE 'changed' END AS reason
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') UNION ALL SELECT DISTINCT 'added', 'extra' FROM orders""",
)
def manifest_and_verify(spark, sf):
    """Writes one file per priority, then removes one file, overwrites one and adds one."""
    path = scratch(spark, "files")
    orders = T.read(spark, sf, "orders").withColumn("folder", F.col("o_orderpriority"))
    orders.repartition("folder").write.partitionBy("folder").parquet(path)
    saved = materialize(W.manifest(spark, path))
    named = {r["folder"]: r["path"] for r in saved.select(_folder().alias("folder"), "path").where("folder is not null").collect()}  # five folders
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(hadoop(f"{path}/{named['1-URGENT']}"), False)
    changed = files.create(hadoop(f"{path}/{named['2-HIGH']}"), True)
    changed.write(bytearray(named["2-HIGH"].encode()))
    changed.close()
    orders.where("o_orderkey % 7 = 0").repartition(1).write.parquet(f"{path}/folder=added")
    found = W.verify(saved, W.manifest(spark, path))
    return found.select(_folder().alias("subject"), "reason").where("subject is not null")


def _folder():
    """Folder of a data file of the listing; NULL for other files."""
    return F.when(F.col("path").endswith(".parquet"), F.regexp_extract("path", "folder=([^/]+)/", 1))


@query(
    "b08_normalized_ontology_tables",
    with_tables(
        "terms",
        "parents",
        "associations",
        body="""SELECT 'terms' AS name, t.hpo_id, t.label || '|' || coalesce(string_agg('HP:' || lpad(CAST(p.parent AS VARCHAR), 7, '0'), ',' ORDER BY p.parent), '') || '|' || CAST(t.obsolete AS VARCHAR) || '|' || coalesce(t.replaced_by, '') AS cells,
  'r1' AS release, 'lic' AS license_reference, 'c2' AS source_checksum FROM terms t LEFT JOIN parents p ON p.child = t.k GROUP BY t.hpo_id, t.label, t.obsolete, t.replaced_by
UNION ALL SELECT 'genes', 'HP:' || lpad(CAST(k AS VARCHAR), 7, '0'), gene || '|' || k || '|' || coalesce(qualifier, '') || '|' || evidence, 'r1', 'lic', 'c0' FROM associations
UNION ALL SELECT 'diseases', 'HP:' || lpad(CAST(k AS VARCHAR), 7, '0'), disease_id || '||' || coalesce(qualifier, '') || '|' || evidence, 'r1', 'lic', 'c1' FROM associations""",
    ),
)
def normalized_ontology_tables(spark, sf):
    """The written tables read back, with their cells."""
    path = scratch(spark, "hpo")
    files = X.official_files(spark, sf)
    genes = ST.read_hpo_annotations(spark, files, "genes", "r1", "lic", "c0")
    diseases = ST.read_hpo_annotations(spark, files, "diseases", "r1", "lic", "c1")
    W.write_tables(
        W.normalize_hpo(S.terms(spark, sf).drop("k"), genes, diseases, "r1", "lic", "c2"), path
    )
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cells = {
        "terms": [text("label"), F.array_join("parents", ","), text("obsolete"), text("replaced_by")],
        "genes": [text("gene"), text("ncbi_gene_id"), text("qualifier"), text("evidence")],
        "diseases": [text("disease_id"), F.lit(""), text("qualifier"), text("evidence")],
    }
    parts = None
    for name, columns in cells.items():
        one = spark.read.parquet(f"{path}/{name}.parquet").select(
            F.lit(name).alias("name"), "hpo_id", F.concat_ws("|", *columns).alias("cells"), "release", "license_reference", "source_checksum"
        )
        parts = one if parts is None else parts.unionByName(one)
    return parts
