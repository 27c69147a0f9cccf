"""Scalar functions and filters (inventory C and D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom import constants as K
from varloom.functions import fields
from varloom.functions import genotype as G
from varloom.functions import registry as SQLF
from varloom.functions.sensitive import redact_map, scan_sensitive
from varloom.operators import annotate as A
from varloom.operators import coverage as C
from varloom.operators import evidence as E
from varloom.operators import filters as D
from varloom.operators import ontology as O
from varloom.operators import quality as Q
from varloom.operators import ranking as R
from varloom.operators import selection as SEL
from varloom.sources import vcf as V
from workload import shared as S
from workload import tables as T
from workload import text as X
from workload.queries_sources import CHROM, ZYGOSITY
from workload.registry import query, with_tables

SCORE_CASE = "CASE consequence " + " ".join(
    f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in K.CONSEQUENCE_SCORES.items()
) + " ELSE 0.1::DOUBLE END"
FEATURES_SQL = f"""
feats AS (
  SELECT *, round(CASE WHEN quality IS NULL THEN 0.5 ELSE least(greatest(quality / 100, 0), 1) END::DOUBLE + 1e-9, 6) AS f_quality,
    round(CASE WHEN allele_frequency IS NULL THEN 0.6 ELSE greatest(0, 1 - least(allele_frequency / 0.01::DOUBLE, 1)) END::DOUBLE + 1e-9, 6) AS f_rarity,
    {SCORE_CASE} AS f_consequence
  FROM variants)"""


@query(
    "c01_info_map",
    with_tables(
        "variants",
        body="""SELECT variant_id, gene, CAST(allele_frequency AS DOUBLE) AS af, 'true' AS db, 'last' AS dup, '' AS strict_flag
FROM variants""",
    ),
)
def info_map(spark, sf):
    """Loose form on text with a repeated key and a flag; strict form on the flag alone."""
    v = T.variants(spark, sf)
    n_alt = F.when(F.col("row_id") % 5 == 0, 2).otherwise(1)
    text = F.concat(F.lit("K=first;"), X.info_text(), F.lit(";K=last"))
    loose = fields.info_map(text)
    return v.select("variant_id", n_alt.alias("n_alt"), loose.alias("m"), fields.info_map(F.lit("DB;A=1"), strict=True).alias("s")).select(
        "variant_id",
        F.col("m")["GENE"].alias("gene"),
        fields.checked_number(fields.per_allele(F.col("m")["AF"], F.lit(0), F.col("n_alt"))).alias("af"),
        F.col("m")["DB"].alias("db"),
        F.col("m")["K"].alias("dup"),
        F.col("s")["DB"].alias("strict_flag"),
    )


@query(
    "c02_per_allele_value",
    with_tables(
        "keyed",
        body="""SELECT row_id, CAST(i AS BIGINT) AS i, CASE row_id % 3
  WHEN 0 THEN CASE i WHEN 0 THEN CAST(ok AS VARCHAR) ELSE CAST(ln AS VARCHAR) END
  WHEN 1 THEN CAST(ok AS VARCHAR) ELSE ok || ',' || ln || ',' || g END AS value
FROM keyed CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1) x""",
    ),
)
def per_allele_value(spark, sf):
    k = T.derived(spark, sf, "keyed")
    s = lambda c: F.col(c).cast("string")
    raw = F.when(F.col("row_id") % 3 == 0, F.concat_ws(",", s("ok"), s("ln"))).when(
        F.col("row_id") % 3 == 1, s("ok")
    ).otherwise(F.concat_ws(",", s("ok"), s("ln"), s("g")))
    return k.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(1)))).select(
        "row_id", F.col("i").cast("bigint").alias("i"), fields.per_allele(raw, F.col("i"), F.lit(2)).alias("value")
    )


@query(
    "c03_multi_allelic_split",
    with_tables(
        "variants",
        body="""SELECT path, chromosome, n_alt, count(*) AS alleles, sum(position) AS positions,
  sum(len) AS alternate_length FROM (
  SELECT run_id || '.vcf' AS path, chromosome, position, CASE WHEN row_id % 5 = 0 THEN 2 ELSE 1 END AS n_alt,
    1 + i AS len, i FROM variants JOIN (SELECT 0 AS i UNION ALL SELECT 1) x ON i = 0 OR row_id % 5 = 0)
GROUP BY ALL""",
    ),
)
def multi_allelic_split(spark, sf):
    rows = V.split_alleles(X.vcf_lines(spark, sf))
    per_record = rows.groupBy("path", "line_no").agg(
        F.count(F.lit(1)).alias("n_alt"),
        F.any_value("chromosome").alias("chromosome"),
        F.sum("position").alias("positions"),
        F.sum(F.length("alternate")).alias("len"),
    )
    return per_record.groupBy("path", "chromosome", "n_alt").agg(
        F.sum("n_alt").alias("alleles"), F.sum("positions").alias("positions"), F.sum("len").alias("alternate_length")
    )


@query(
    "c04_variant_identifier",
    with_tables(
        "variants",
        body=f"""SELECT row_id, CASE WHEN row_id % 3 = 0 THEN {CHROM} || '-' || position || '-' || reference || '-' || alternate
  WHEN row_id % 5 = 0 THEN variant_id || ':' || alternate ELSE variant_id END AS id FROM variants""",
    ),
)
def variant_identifier(spark, sf):
    v = T.variants(spark, sf)
    return v.select(
        "row_id",
        fields.variant_id(
            F.when(F.col("row_id") % 3 == 0, ".").otherwise(F.col("variant_id")),
            X.chrom(), F.col("position"), F.col("reference"), F.col("alternate"),
            F.when(F.col("row_id") % 5 == 0, 2).otherwise(1),
        ).alias("id"),
    )


@query(
    "c05_genotype_calls",
    with_tables(
        "variants",
        body="""SELECT row_id, s AS sample, CASE s WHEN 'P' THEN genotype WHEN 'M' THEN m_gt ELSE f_gt END AS genotype,
  CASE s WHEN 'P' THEN p_gq WHEN 'M' THEN m_gq ELSE f_gq END AS quality, CASE s WHEN 'P' THEN p_vaf END AS alternate_fraction
FROM variants CROSS JOIN (SELECT 'P' AS s UNION ALL SELECT 'M' UNION ALL SELECT 'F') x""",
    ),
)
def genotype_calls(spark, sf):
    lines = V.record_fields(X.record_lines(spark, sf))
    calls = V.genotype_calls(
        F.get("f", F.lit(8)), F.slice("f", 10, 100), F.array(*[F.lit(s) for s in "PMF"])
    )
    return lines.select((F.col("line_no") - 100).alias("row_id"), F.explode(calls).alias("sample", "c")).select(
        "row_id", "sample", "c.*"
    )


@query(
    "c06_zygosity",
    with_tables("variants", body=f"""SELECT {ZYGOSITY} AS zygosity, m AS mother, count(*) AS n FROM (
  SELECT *, CASE m_gt WHEN '0/1' THEN 'heterozygous' WHEN '1/1' THEN 'homozygous_alternate' WHEN '0/0' THEN 'reference' END AS m
  FROM variants) GROUP BY ALL"""),
)
def zygosity(spark, sf):
    return (
        T.variants(spark, sf)
        .select(G.zygosity(F.col("genotype")).alias("zygosity"), G.zygosity(F.col("m_gt")).alias("mother"))
        .groupBy("zygosity", "mother")
        .agg(F.count(F.lit(1)).alias("n"))
    )


GT_VALUES = ("0/1", "1|0", "1/2", "1/1", "0/0", "0|0", "0", "1", ".", "./.", "./1", "2|2")
GT_CASE = "CASE row_id % 12 " + " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(GT_VALUES)) + " END"


@query(
    "c07_genotype_predicates",
    with_tables(
        "keyed",
        extra=f"""g AS (SELECT row_id, {GT_CASE} AS gt FROM keyed),
s AS (SELECT *, string_split_regex(gt, '[/|]') AS a, gt NOT IN ('.', './.') AND NOT contains(gt, '.') AS called FROM g)""",
        body="""SELECT row_id, gt, called, called AND len(list_filter(a, lambda x: x <> '0')) > 0 AS has_alt,
  called AND len(list_filter(a, lambda x: x <> '0')) = 0 AS is_ref,
  called AND len(a) = 2 AND a[1] <> a[2] AS is_het, called AND len(a) = 2 AND a[1] = a[2] AND a[1] <> '0' AS is_hom_alt FROM s""",
    ),
)
def genotype_predicates(spark, sf):
    k = T.derived(spark, sf, "keyed").select("row_id", F.expr(GT_CASE).alias("gt"))
    gt = F.col("gt")
    return k.select(
        "row_id",
        "gt",
        G.gt_called(gt).alias("called"),
        G.gt_has_alt(gt).alias("has_alt"),
        G.gt_is_ref(gt).alias("is_ref"),
        G.gt_is_het(gt).alias("is_het"),
        G.gt_is_hom_alt(gt).alias("is_hom_alt"),
    )


@query(
    "c08_saved_genotype_state",
    with_tables(
        "variants",
        body="""SELECT variant_id, CASE WHEN m_gt = './.' THEN 'unknown' WHEN m_gt = '0/0' THEN 'reference'
  WHEN m_gt = '1/1' THEN 'homozygous_alt' ELSE 'heterozygous' END AS state, m_gt = '0/0' AS reference_call FROM variants""",
    ),
)
def saved_genotype_state(spark, sf):
    return T.variants(spark, sf).select(
        "variant_id",
        G.genotype_state(F.col("m_gt")).alias("state"),
        G.called_reference(F.col("m_gt")).alias("reference_call"),
    )


@query(
    "c09_checked_number",
    """WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '.' WHEN 1 THEN '' WHEN 2 THEN '-' || CAST(event_id AS VARCHAR)
  WHEN 3 THEN 'x' || CAST(event_id AS VARCHAR) ELSE CAST(event_id AS VARCHAR) END AS raw FROM events)
SELECT event_id, event_id % 5 <> 3 AS valid, event_id % 5 NOT IN (2, 3) AS strict_valid, CASE WHEN raw NOT IN ('.', '') THEN TRY_CAST(raw AS DOUBLE) END AS value FROM t""",
)
def checked_number(spark, sf):
    key = F.col("event_id")
    text = key.cast("string")
    raw = (
        F.when(key % 5 == 0, ".")
        .when(key % 5 == 1, "")
        .when(key % 5 == 2, F.concat(F.lit("-"), text))
        .when(key % 5 == 3, F.concat(F.lit("x"), text))
        .otherwise(text)
    )
    e = T.read(spark, sf, "events").select("event_id", raw.alias("raw"))
    ok = fields.is_valid_number(F.col("raw"))
    return e.select(
        "event_id",
        ok.alias("valid"),
        fields.is_valid_number(F.col("raw"), strict=True).alias("strict_valid"),
        fields.checked_number(F.when(ok, F.col("raw"))).alias("value"),
    )


CSQ_SQL = """
csq AS (
  SELECT 'r' || row_id || '_a1' AS allele_id, o AS ordinal, 'E' || g AS e_gene, row_id, g, gene,
    CASE o WHEN 0 THEN coalesce(consequence, 'intron_variant') WHEN 1 THEN 'synonymous_variant&splice_donor_variant' ELSE 'intron_variant' END AS term,
    CASE WHEN o = 2 THEN NULL ELSE gene END AS symbol, CASE WHEN o = 2 THEN 'N' || g ELSE 'E' || g END AS gene_id,
    'T' || g || CASE o WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS feature,
    CASE WHEN o = 0 OR (o = 1 AND row_id % 4 = 0) THEN allele_frequency END AS af
  FROM (SELECT *, pk // 5 AS g FROM variants) v JOIN (SELECT 0 AS o UNION ALL SELECT 1 UNION ALL SELECT 2) x
    ON row_id % 6 <> 0 AND (o < 2 OR row_id % 6 = 1))"""


@query(
    "c10_consequence_decode",
    with_tables(
        "variants",
        extra=CSQ_SQL,
        body="SELECT allele_id, CAST(ordinal AS BIGINT) AS ordinal, term, coalesce(symbol, '') AS symbol, gene_id, feature FROM csq",
    ),
)
def consequence_decode(spark, sf):
    records = A.annotated_records(X.annotated_fields(spark, sf).select("f"))
    rows = A.decode_csq(records.select("allele_id", "csq", "n_alt"), X.CSQ_LAYOUT)
    f = F.col("fields")
    return rows.select(
        "allele_id",
        F.col("ordinal").cast("bigint").alias("ordinal"),
        f["Consequence"].alias("term"),
        f["SYMBOL"].alias("symbol"),
        f["Gene"].alias("gene_id"),
        f["Feature"].alias("feature"),
    )


@query(
    "c11_population_frequency",
    with_tables(
        "variants", extra=CSQ_SQL,
        body="SELECT allele_id, max(af) AS allele_frequency FROM csq GROUP BY allele_id",
    ),
)
def population_frequency(spark, sf):
    records = A.annotated_records(X.annotated_fields(spark, sf).select("f"))
    rows = A.decode_csq(records.select("allele_id", "csq", "n_alt"), X.CSQ_LAYOUT)
    return A.population_frequency(rows, ["allele_id"])


@query(
    "c12_contig_canonicalisation",
    """WITH n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'chr' ELSE '' END || CASE WHEN s_suppkey % 27 = 23 THEN 'X'
  WHEN s_suppkey % 27 = 24 THEN 'Y' WHEN s_suppkey % 27 = 25 THEN 'M' WHEN s_suppkey % 27 = 26 THEN 'GL1' ELSE CAST(s_suppkey % 27 AS VARCHAR) END AS name FROM supplier),
c AS (SELECT *, CASE WHEN regexp_replace(name, '^chr', '') = 'M' THEN 'MT'
  WHEN regexp_matches(regexp_replace(name, '^chr', ''), '^([1-9]|1[0-9]|2[0-2]|X|Y|MT)$') THEN regexp_replace(name, '^chr', '') END AS target FROM n)
SELECT name, target, count(*) AS suppliers, (SELECT count(DISTINCT name) FROM c d WHERE d.target = c.target) > 1 AS collides FROM c GROUP BY name, target""",
)
def contig_canonicalisation(spark, sf):
    k = F.col("s_suppkey")
    r = k % 27
    name = F.concat(
        F.when(k % 2 == 0, "chr").otherwise(""),
        F.when(r == 23, "X").when(r == 24, "Y").when(r == 25, "M").when(r == 26, "GL1").otherwise(r.cast("string")),
    )
    named = (
        T.read(spark, sf, "supplier").select(name.alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("suppliers"))
    )
    hit = C.contig_collisions(named).select("target", F.lit(True).alias("_c"))
    return (
        named.withColumn("target", fields.canonical_contig(F.col("name")))
        .join(hit, "target", "left")
        .select("name", "target", "suppliers", F.coalesce("_c", F.lit(False)).alias("collides"))
    )


@query(
    "c13_chromosome_presentation",
    with_tables("variants", body=f"SELECT {CHROM} AS name, 'chr' || chromosome AS shown, count(*) AS n FROM variants GROUP BY ALL"),
)
def chromosome_presentation(spark, sf):
    return (
        T.variants(spark, sf)
        .select(X.chrom().alias("name"))
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("shown", fields.present_chrom(F.col("name")))
    )


@query(
    "c14_candidate_key",
    with_tables(
        "variants",
        body="""SELECT row_id, 'r' || row_id || '_a1' AS allele_id,
  'r' || row_id || '_a1_g' || substr(sha256(coalesce(gene, 'unassigned')), 1, 16) AS candidate FROM variants""",
    ),
)
def candidate_key(spark, sf):
    allele = fields.allele_id(F.col("row_id"), F.lit(1))
    return T.variants(spark, sf).select(
        "row_id",
        allele.alias("allele_id"),
        fields.candidate_key(allele, F.coalesce("gene", F.lit("unassigned"))).alias("candidate"),
    )


@query(
    "c15_record_identity",
    with_tables("variants", body="SELECT run_id, count(*) AS records, count(*) AS unchanged, CAST(0 AS BIGINT) AS changed_by_quality FROM variants GROUP BY run_id"),
)
def record_identity(spark, sf):
    """The digest ignores INFO growth and sees any other edit."""
    plain = X.annotated_fields(spark, sf, with_csq=False)
    grown = X.annotated_fields(spark, sf)
    info = lambda f: fields.info_map(F.get(f, F.lit(7)), strict=True)

    def digest(f):
        m = info(f)
        return fields.record_identity(F.col(f), m[K.SOURCE_ROW_TAG], m[K.SOURCE_ALT_TAG])

    a = plain.select("run_id", F.get("f", F.lit(1)).alias("pos"), digest("f").alias("d0"),
                     F.transform("f", lambda x, i: F.when(i == 5, "99999").otherwise(x)).alias("f1"))
    a = a.select("run_id", "pos", "d0", digest("f1").alias("d1"))
    b = grown.select(F.get("f", F.lit(1)).alias("pos"), digest("f").alias("d2"))
    return a.join(b, "pos").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("d0") == F.col("d2")).alias("unchanged"),
        F.count_if(F.col("d1") == F.col("d2")).alias("changed_by_quality"),
    )


@query(
    "c16_genotype_projection",
    with_tables(
        "keyed",
        extra="""g AS (SELECT row_id, CASE row_id % 7 WHEN 0 THEN '0/1' WHEN 1 THEN '1|2' WHEN 2 THEN './2' WHEN 3 THEN '12/2' WHEN 4 THEN '2'
  WHEN 5 THEN '0|0' ELSE '10/1' END AS gt FROM keyed)""",
        body="""SELECT row_id, CAST(k AS BIGINT) AS k, array_to_string(list_transform(regexp_extract_all(gt, '[0-9]+|[/|.]'), lambda t:
  CASE WHEN t IN ('/', '|', '.') THEN t WHEN t = CAST(k AS VARCHAR) THEN '1' ELSE '0' END), '') AS projected
FROM g CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) x""",
    ),
)
def genotype_projection(spark, sf):
    gts = ("0/1", "1|2", "./2", "12/2", "2", "0|0", "10/1")
    gt = F.get(F.array(*[F.lit(g) for g in gts]), (F.col("row_id") % 7).cast("int"))
    rows = T.derived(spark, sf, "keyed").select(
        "row_id", gt.alias("gt"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k")
    )
    return rows.select(
        "row_id", F.col("k").cast("bigint").alias("k"), G.project_gt(F.col("gt"), F.col("k")).alias("projected")
    )


RECORDS_SQL = """
src AS (
  SELECT event_id, 's' || (user_id % 3) AS source, row_number() OVER (PARTITION BY user_id % 3 ORDER BY user_id, ts, event_id) AS ordinal,
    CAST(user_id % 24 + 1 AS VARCHAR) AS contig0, user_id, event_type,
    CASE event_id % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'C,G' WHEN 2 THEN '.' ELSE CASE WHEN event_type = 'error' THEN '<DEL>' ELSE 'T' END END AS alt_text,
    CASE WHEN event_type = 'purchase' THEN '1' ELSE '0/1' END AS genotype
  FROM events),
recs AS (
  SELECT *, CASE contig0 WHEN '23' THEN 'X' WHEN '24' THEN 'M' ELSE CASE WHEN user_id % 19 = 0 THEN 'chr' || contig0 WHEN user_id % 31 = 0 THEN 'GL' || contig0 ELSE contig0 END END AS chrom,
    CASE WHEN alt_text = '.' THEN 0 ELSE len(string_split(alt_text, ',')) END AS n_alt,
    'line' || event_id AS line FROM src),
disp AS (
  SELECT *, chrom AS chromosome, CASE
    WHEN regexp_replace(chrom, '^chr', '') IN ('X', 'Y') THEN 'sex_chromosome_context_pending'
    WHEN regexp_replace(chrom, '^chr', '') IN ('M', 'MT') THEN 'mitochondrial_context_pending'
    WHEN NOT regexp_matches(regexp_replace(chrom, '^chr', ''), '^([1-9]|1[0-9]|2[0-2])$') THEN 'nonstandard_contig_pending'
    WHEN chrom LIKE 'chr%' THEN 'reference_alias_pending'
    WHEN alt_text = '.' OR alt_text = '<DEL>' THEN 'nonsequence_allele_pending'
    WHEN genotype = '1' THEN 'autosomal_ploidy_pending' ELSE 'eligible_autosomal_sequence' END AS disposition
  FROM recs)"""


def source_records(spark, sf):
    """Event rows in (user, time) order as records of three sources, with their ordinal."""
    from varloom.operators.ordering import rank_within

    def build():
        u = F.col("user_id")
        e = T.read(spark, sf, "events").select(
            "event_id", "user_id", "ts", "event_type",
            F.concat(F.lit("s"), (u % 3).cast("string")).alias("source"),
        )
        ranked = rank_within(e, ["source"], [F.col("user_id"), F.col("ts"), F.col("event_id")], "ordinal")
        base = (u % 24 + 1).cast("string")
        chrom = (
            F.when(u % 24 == 22, "X")
            .when(u % 24 == 23, "M")
            .when(u % 19 == 0, F.concat(F.lit("chr"), base))
            .when(u % 31 == 0, F.concat(F.lit("GL"), base))
            .otherwise(base)
        )
        k = F.col("event_id") % 4
        alt = (
            F.when(k == 0, "C").when(k == 1, "C,G").when(k == 2, ".")
            .otherwise(F.when(F.col("event_type") == "error", "<DEL>").otherwise("T"))
        )
        rows = ranked.select(
            "event_id", "source", "ordinal", chrom.alias("chrom"), F.lit("A").alias("reference"), alt.alias("alt_text"),
            F.when(F.col("event_type") == "purchase", "1").otherwise("0/1").alias("genotype"),
            F.concat(F.lit("line"), F.col("event_id").cast("string")).alias("line"),
        )
        return C.disposition(rows).withColumn("chromosome", F.col("chrom"))

    return T.once(spark, sf, "source_records", build)


@query(
    "c17_source_tags",
    f"""WITH {RECORDS_SQL.strip()}
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'DP=1;' END || 'RDA_SOURCE_ROW=' || ordinal || ';RDA_ALT_IDX=' ||
  CASE n_alt WHEN 0 THEN '' WHEN 1 THEN '1' ELSE '1,2' END AS info_text FROM recs""",
)
def source_tags(spark, sf):
    rows = source_records(spark, sf).withColumn(
        "info_text", F.when(F.col("event_id") % 3 == 0, ".").otherwise("DP=1")
    )
    return C.tag_source(rows).select("event_id", "info_text")


@query(
    "c18_record_disposition",
    f"WITH {RECORDS_SQL.strip()} SELECT event_id, chrom, CAST(n_alt AS BIGINT) AS n_alt, disposition FROM disp",
)
def record_disposition(spark, sf):
    return source_records(spark, sf).select(
        "event_id", "chrom", F.col("n_alt").cast("bigint").alias("n_alt"), "disposition"
    )


@query(
    "c18_ambiguous_aliases",
    f"""WITH {RECORDS_SQL.strip()}
SELECT source, regexp_replace(chrom, '^chr', '') AS contig, min(chrom) AS first_name, max(chrom) AS last_name FROM disp
WHERE regexp_matches(regexp_replace(chrom, '^chr', ''), '^([1-9]|1[0-9]|2[0-2])$') GROUP BY ALL HAVING min(chrom) <> max(chrom)""",
)
def ambiguous_aliases(spark, sf):
    return C.ambiguous_aliases(source_records(spark, sf))


@query(
    "c18_record_structure_checks",
    """WITH r AS (SELECT event_id, event_id % 11 AS k FROM events)
SELECT CASE k WHEN 1 THEN 'malformed_record' WHEN 2 THEN 'reserved_source_tag' WHEN 3 THEN 'malformed_alleles' WHEN 4 THEN 'malformed_genotype_fields'
  WHEN 5 THEN 'malformed_genotype' WHEN 6 THEN 'genotype_above_alternates' END AS reason, count(*) AS n FROM r WHERE k BETWEEN 1 AND 6 GROUP BY 1""",
)
def record_structure_checks(spark, sf):
    k = F.col("event_id") % 11
    cols = [
        F.lit("1"),
        F.when(k == 1, "x").otherwise((F.col("event_id") + 1).cast("string")),
        F.lit("."),
        F.lit("A"),
        F.when(k == 3, "C,C").otherwise("C"),
        F.lit("."),
        F.lit("PASS"),
        F.when(k == 2, f"{K.SOURCE_ROW_TAG}=4").otherwise("DP=1"),
        F.when(k == 4, "GT:GT").otherwise("GT:GQ"),
        F.when(k == 5, "0/1|1:3").when(k == 6, "0/2:3").otherwise("0/1:3"),
    ]
    records = T.read(spark, sf, "events").select("event_id", F.array(*cols).alias("f"))
    return (
        C.record_violations(records)
        .select(F.explode("reasons").alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


TERM_INPUT_SQL = """
given AS (
  SELECT c_custkey % 50 AS run, c_custkey AS position, CASE c_custkey % 6 WHEN 0 THEN ' hp:' || lpad(CAST(c_custkey % 99 + 1 AS VARCHAR), 7, '0') || ' '
    WHEN 1 THEN 'HP:99' WHEN 2 THEN 'HP:' || lpad(CAST(c_custkey + 5000000 AS VARCHAR), 7, '0') WHEN 3 THEN 'HP:' || lpad(CAST((c_custkey % 6) * 50 + 49 + 50 * (c_custkey % 4) AS VARCHAR), 7, '0')
    ELSE 'HP:' || lpad(CAST(c_custkey % 150 + 1 AS VARCHAR), 7, '0') END AS raw FROM customer)"""


@query(
    "c19_term_normalisation",
    with_tables(
        "terms",
        extra=TERM_INPUT_SQL
        + """,
n AS (SELECT *, upper(trim(raw)) AS value FROM given),
j AS (SELECT n.*, t.obsolete, t.hpo_id IS NOT NULL AS found, t.obsolete AND t.replaced_by IN (SELECT hpo_id FROM terms) AS replaced, t.replaced_by
  FROM n LEFT JOIN terms t ON t.hpo_id = n.value),
s AS (SELECT *, CASE WHEN NOT regexp_full_match(value, 'HP:[0-9]{7}') THEN 'invalid' WHEN NOT found THEN 'unknown'
    WHEN obsolete AND NOT coalesce(replaced, false) THEN 'obsolete_dropped' ELSE 'kept' END AS st,
    CASE WHEN coalesce(replaced, false) THEN replaced_by ELSE value END AS term FROM j),
d AS (SELECT *, row_number() OVER (PARTITION BY run, st, term ORDER BY position) AS n FROM s)""",
        body="""SELECT run, position, raw, coalesce(replaced, false) AS replaced, CASE WHEN st = 'kept' AND n > 1 THEN 'duplicate' ELSE st END AS status,
  CASE WHEN st = 'kept' AND n = 1 THEN term END AS hpo_id FROM d""",
    ),
)
def term_normalisation(spark, sf):
    k = F.col("c_custkey")
    pad = lambda x: F.lpad(x.cast("string"), 7, "0")
    m = k % 6
    raw = (
        F.when(m == 0, F.concat(F.lit(" hp:"), pad(k % 99 + 1), F.lit(" ")))
        .when(m == 1, "HP:99")
        .when(m == 2, F.concat(F.lit("HP:"), pad(k + 5000000)))
        .when(m == 3, F.concat(F.lit("HP:"), pad(m * 50 + 49 + (k % 4) * 50)))
        .otherwise(F.concat(F.lit("HP:"), pad(k % 150 + 1)))
    )
    given = T.read(spark, sf, "customer").select((k % 50).alias("run"), k.alias("position"), raw.alias("raw"))
    return O.normalize_terms(given, S.terms(spark, sf), "run")


@query(
    "c20_ranking_features",
    with_tables(
        "variants", extra=FEATURES_SQL,
        body="SELECT variant_id, f_quality AS quality, f_rarity AS rarity, f_consequence AS consequence, 0.25::DOUBLE AS phenotype, 0::DOUBLE AS inheritance FROM feats",
    ),
)
def ranking_features(spark, sf):
    v = T.variants(spark, sf).withColumns(
        {"phenotype_score": F.lit(0.25).cast("double"), "inheritance_score": F.lit(None).cast("double")}
    )
    return R.ranking_features(v).select("variant_id", "features.*")


@query(
    "c21_weighted_score",
    with_tables(
        "variants", extra=FEATURES_SQL,
        body="""SELECT variant_id, round((f_quality * 0.10::DOUBLE + f_rarity * 0.20::DOUBLE + f_consequence * 0.15::DOUBLE) / (0.10::DOUBLE + 0.20::DOUBLE + 0.15::DOUBLE) + 1e-9, 6) AS filtering_only,
  round((f_quality * 0.10::DOUBLE + f_rarity * 0.20::DOUBLE + f_consequence * 0.15::DOUBLE + 0.25::DOUBLE * 0.30::DOUBLE) / (0.10::DOUBLE + 0.20::DOUBLE + 0.15::DOUBLE + 0.30::DOUBLE + 0.25::DOUBLE) + 1e-9, 6) AS full_score FROM feats""",
    ),
)
def weighted_score(spark, sf):
    v = T.variants(spark, sf).withColumns(
        {"phenotype_score": F.lit(0.25).cast("double"), "inheritance_score": F.lit(None).cast("double")}
    )
    weights = dict(zip(K.FEATURES, K.DEFAULT_WEIGHTS, strict=True))
    return R.ranking_features(v).select(
        "variant_id",
        R.weighted_score(weights, "filtering_only").alias("filtering_only"),
        R.weighted_score(weights, K.BASE_MODE).alias("full_score"),
    )


@query(
    "c22_rank_mass",
    """SELECT o_orderkey, CAST(0.5 * 0.2 * power(0.8, o_orderkey % 10) AS DOUBLE) AS mass,
  length(CASE WHEN o_orderkey % 10 = 0 THEN '0.1000' ELSE '0.' || repeat('0', 2 * (o_orderkey % 10)) || '0000' END) AS text_length,
  CAST(1 - 0.5 * (1 - power(0.8, o_orderkey % 11)) AS DOUBLE) AS residual FROM orders""",
)
def rank_mass(spark, sf):
    o = T.read(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 10 + 1).alias("r"))
    return o.select(
        "o_orderkey",
        F.round(SEL.epcr(F.col("r")).cast("double"), 9).alias("mass"),
        F.length(SEL.epcr_text(F.col("r"))).cast("bigint").alias("text_length"),
        F.round(SEL.residual(F.col("o_orderkey") % 11).cast("double"), 9).alias("residual"),
    )


@query(
    "c23_coordinate_key",
    with_tables("variants", body="SELECT variant_id, upper(chromosome) || ':' || position || ':' || reference || ':' || alternate AS coord FROM variants"),
)
def coordinate_key(spark, sf):
    key = fields.coordinate_key(X.chrom(), F.col("position"), F.lower("reference"), F.col("alternate"))
    return T.variants(spark, sf).select("variant_id", key.alias("k")).select(
        "variant_id", F.concat_ws(":", "k.chrom", F.col("k.pos").cast("string"), "k.ref", "k.alt").alias("coord")
    )


SALT = b"0123456789abcdef"
_PAD = SALT.ljust(64, b"\0")
IPAD = bytes(b ^ 0x36 for b in _PAD).hex().upper()
OPAD = bytes(b ^ 0x5C for b in _PAD).hex().upper()


@query(
    "c24_keyed_pseudonym",
    with_tables(
        "variants",
        body=f"""SELECT variant_id, 'candidate-' || substr(sha256(unhex('{OPAD}') || unhex(sha256(unhex('{IPAD}') || encode(variant_id)))), 1, 16) AS candidate_ref FROM variants""",
    ),
)
def keyed_pseudonym(spark, sf):
    return T.variants(spark, sf).select(
        "variant_id", fields.pseudonym(F.col("variant_id"), SALT).alias("candidate_ref")
    )


@query(
    "c25_field_redaction",
    "SELECT event_id, '[REDACTED]' AS patient, '[REDACTED]' AS api_key, event_type AS event, event_type AS plain FROM events",
)
def field_redaction(spark, sf):
    e = T.read(spark, sf, "events")
    values = F.create_map(
        F.lit("patient_id"), F.col("user_id").cast("string"),
        F.lit("my_API_KEY"), F.col("props"),
        F.lit("event"), F.col("event_type"),
        F.lit("plain"), F.col("event_type"),
    )
    return e.select("event_id", redact_map(values).alias("m")).select(
        "event_id",
        F.col("m")["patient_id"].alias("patient"),
        F.col("m")["my_API_KEY"].alias("api_key"),
        F.col("m")["event"].alias("event"),
        F.col("m")["plain"].alias("plain"),
    )


SCAN_SQL = r"""
SELECT id, reason FROM d, (SELECT 'VCF content without synthetic marker' AS reason UNION ALL SELECT 'possible Hugging Face access token'
  UNION ALL SELECT 'possible private key' UNION ALL SELECT 'possible generic credential assignment') r
WHERE CASE reason WHEN 'VCF content without synthetic marker' THEN contains(text, '##fileformat=VCF') AND NOT contains(text, '##synthetic=true')
  WHEN 'possible Hugging Face access token' THEN regexp_matches(text, '\bhf_[A-Za-z0-9]{20,}\b')
  WHEN 'possible private key' THEN regexp_matches(text, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----')
  ELSE regexp_matches(text, '(?i)\b(?:api[_-]?key|access[_-]?token|password)\s*[:=]\s*[''"]?[A-Za-z0-9_\-/+]{16,}') END"""


@query(
    "c26_sensitive_content_scan",
    """WITH d AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL
  SELECT 'p' || page_id, html || CASE WHEN page_id % 4 = 0 THEN ' api_key = ' || repeat('k', 20) WHEN page_id % 4 = 1 THEN ' ##fileformat=VCFv4' ELSE '' END FROM pages
  UNION ALL SELECT 'c' || conv_id || '-' || turn, text || CASE WHEN conv_id % 3 = 0 THEN ' hf_' || repeat('a', 24) ELSE '' END FROM conversations
  UNION ALL SELECT 'b' || item_id, text FROM benchmark)""" + SCAN_SQL,
)
def sensitive_content_scan(spark, sf):
    docs = T.read(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    m = F.col("page_id") % 4
    pages = T.read(spark, sf, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"),
        F.concat(
            "html",
            F.when(m == 0, " api_key = " + "k" * 20).when(m == 1, " ##fileformat=VCFv4").otherwise(""),
        ).alias("text"),
    )
    talks = T.read(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.concat("text", F.when(F.col("conv_id") % 3 == 0, " hf_" + "a" * 24).otherwise("")).alias("text"),
    )
    items = T.read(spark, sf, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), "text")
    return scan_sensitive(docs.unionByName(pages).unionByName(talks).unionByName(items))


@query(
    "c26_restricted_path_scan",
    """WITH d AS (SELECT url AS id, url, html || CASE WHEN page_id % 7 = 0 THEN ' api_key = ' || repeat('k', 20) WHEN page_id % 7 = 1 THEN ' ##fileformat=VCFv4' ELSE '' END AS text,
  'a/' || CASE page_id % 5 WHEN 0 THEN 'secrets/x.txt' WHEN 1 THEN 'b/y.VCF' WHEN 2 THEN 'cache/z.bam' ELSE 'ok/w.md' END AS path FROM pages)
SELECT url, path, 'restricted/generated directory' AS reason FROM d WHERE path LIKE '%/secrets/%' OR path LIKE '%/cache/%'
UNION ALL SELECT url, path, 'restricted genomic/data file type' FROM d WHERE lower(path) LIKE '%.vcf' OR path LIKE '%.bam'
UNION ALL SELECT url, path, reason FROM (""" + SCAN_SQL.replace("SELECT id, reason", "SELECT url, path, reason") + """)
WHERE reason <> 'VCF content without synthetic marker' OR list_contains(['.txt'], lower(regexp_extract(path, '[.][a-zA-Z]+$')))""",
)
def restricted_path_scan(spark, sf):
    """All rules, of paths and of contents."""
    m, k = F.col("page_id") % 5, F.col("page_id") % 7
    pages = T.read(spark, sf, "pages").select(
        "url",
        F.concat("html", F.when(k == 0, " api_key = " + "k" * 20).when(k == 1, " ##fileformat=VCFv4").otherwise("")).alias("text"),
        F.concat(
            F.lit("a/"),
            F.when(m == 0, "secrets/x.txt").when(m == 1, "b/y.VCF").when(m == 2, "cache/z.bam").otherwise("ok/w.md"),
        ).alias("path"),
    )
    return scan_sensitive(pages, "text", "path")


@query(
    "c27_evidence_payload_json",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS method, value AS score FROM events""",
)
def evidence_payload_json(spark, sf):
    """Payload written as JSON and read back by path, next to a path read of given JSON."""
    e = T.read(spark, sf, "events").withColumn(
        "payload", E.to_payload(F.col("event_type").alias("method"), F.col("value").alias("score"))
    )
    return e.select(
        "event_id",
        E.payload_field(F.col("props"), "k").cast("bigint").alias("k"),
        E.payload_field(F.col("payload"), "method").alias("method"),
        E.payload_field(F.col("payload"), "score").cast("double").alias("score"),
    )


@query(
    "c28_provenance",
    with_tables("variants", body="""SELECT variant_id, run_id AS p_run, 'm-' || chromosome AS p_method, 't1' AS tool, 'd1' AS data, '20' AS min_quality FROM variants"""),
)
def provenance(spark, sf):
    v = T.variants(spark, sf)
    p = E.with_provenance(v, F.concat(F.lit("m-"), "chromosome"), "t1", "d1", {"min_quality": "20"})
    return p.select(
        "variant_id",
        F.col("provenance.run_id").alias("p_run"),
        F.col("provenance.method").alias("p_method"),
        F.col("provenance.tool_version").alias("tool"),
        F.col("provenance.data_version").alias("data"),
        F.col("provenance.parameters")["min_quality"].alias("min_quality"),
    )


@query(
    "l01_sql_functions",
    with_tables(
        "variants", extra=FEATURES_SQL,
        body="""SELECT variant_id, m_gt <> './.' AS called, m_gt = '0/0' AS is_ref, chromosome AS contig, f_quality AS quality, f_rarity AS rarity FROM feats""",
    ),
)
def sql_functions(spark, sf):
    """The registered SQL functions over the variant table, called from SQL text."""
    SQLF.register(spark)
    return spark.sql(
        "SELECT variant_id, gt_called(m_gt) AS called, gt_is_ref(m_gt) AS is_ref, "
        "canonical_contig(concat('chr', chromosome)) AS contig, "
        "round(feature_quality(quality) + 1e-9D, 6) AS quality, "
        "round(feature_rarity(allele_frequency) + 1e-9D, 6) AS rarity FROM {v}",
        v=T.variants(spark, sf),
    )


# --- filters ----------------------------------------------------------------


def _ids(df):
    return df.select("run_id", "variant_id")


@query("d01_quality_filter", with_tables("variants", body="SELECT run_id, variant_id FROM variants WHERE quality IS NULL OR quality >= 30"))
def quality_filter(spark, sf):
    return _ids(T.variants(spark, sf).where(D.quality_at_least(30)))


@query(
    "d02_rarity_filter",
    with_tables("variants", body="""SELECT run_id, variant_id FROM variants WHERE allele_frequency IS NULL OR allele_frequency <= 0.01
  OR lower(coalesce(clinvar_classification, '')) LIKE '%pathogenic%'"""),
)
def rarity_filter(spark, sf):
    return _ids(T.variants(spark, sf).where(D.rare(0.01)))


@query("d03_consequence_filter", with_tables("variants", body="SELECT run_id, variant_id FROM variants WHERE consequence IN ('stop_gained', 'missense_variant')"))
def consequence_filter(spark, sf):
    return _ids(T.variants(spark, sf).where(D.consequence_in(["stop_gained", "missense_variant"])))


@query("d04_gene_filter", with_tables("variants", body="SELECT run_id, variant_id FROM variants WHERE upper(coalesce(gene, '')) IN ('G7', 'G120', 'UNKNOWN')"))
def gene_filter(spark, sf):
    return _ids(T.variants(spark, sf).where(D.gene_in(["g7", "G120", "unknown"])))


@query(
    "d04_gene_table_filter",
    with_tables("variants", body="SELECT run_id, variant_id FROM variants WHERE upper(coalesce(gene, '')) IN (SELECT 'G' || s_suppkey FROM supplier)"),
)
def gene_table_filter(spark, sf):
    genes = T.read(spark, sf, "supplier").select(F.concat(F.lit("g"), F.col("s_suppkey").cast("string")).alias("gene"))
    return _ids(D.filter_gene_table(T.variants(spark, sf), genes))


@query("d05_clinvar_filter", with_tables("variants", body="SELECT run_id, variant_id FROM variants WHERE lower(coalesce(clinvar_classification, '')) IN ('benign', 'pathogenic')"))
def clinvar_filter(spark, sf):
    return _ids(T.variants(spark, sf).where(D.clinvar_in(["Benign", "PATHOGENIC"])))


@query(
    "d06_adhoc_filter",
    with_tables("variants", body="""SELECT variant_id, chromosome, position FROM variants
WHERE (allele_frequency IS NULL OR allele_frequency <= 0.005 OR lower(clinvar_classification) LIKE '%pathogenic%')
  AND cadd_score >= 20 AND consequence IN ('missense_variant', 'stop_gained', 'start_lost') ORDER BY chromosome, position LIMIT 1000"""),
)
def adhoc_filter(spark, sf):
    """The limit is the page size of this operator."""
    rows = D.filter_variants(
        T.variants(spark, sf), 1000, maximum_frequency=0.005, minimum_cadd=20,
        consequences=["missense_variant", "stop_gained", "start_lost"],
    )
    return rows.select("variant_id", "chromosome", "position")


@query(
    "d07_genomic_preflight",
    with_tables(
        "variants", "pedigree",
        extra="""d AS (
  SELECT v.*, p.p_sex, chromosome IN ('X') AS on_sex, chromosome = 'X' AND position BETWEEN 1 AND 60000 AS par,
    CASE WHEN row_id % 997 = 0 THEN 'N' ELSE reference END AS ref2, CASE WHEN row_id % 211 = 0 THEN 'twice' ELSE variant_id END AS id2 FROM variants v JOIN pedigree p USING (run_id))""",
        body="""SELECT run_id, count(*) AS records, count(*) - count(DISTINCT id2) AS duplicate_variant_id, 'missing_calls_not_imputed,annotations_missing' AS warnings,
  sum((m_gt = './.')::INT + (f_gt = './.')::INT) AS missing_genotypes,
  sum((gene IS NULL)::INT + (consequence IS NULL)::INT + (allele_frequency IS NULL)::INT) AS missing_annotations,
  count(*) FILTER (WHERE ref2 = 'N') AS unnormalized_allele,
  count(*) FILTER (WHERE gene IS NULL OR consequence IS NULL OR allele_frequency IS NULL) AS missing_annotation,
  count(*) FILTER (WHERE p_gq IS NULL) AS genotype_quality_missing,
  count(*) FILTER (WHERE on_sex AND NOT par AND (p_sex = 'male' OR f_gt <> './.')) AS ploidy_mismatch
FROM d GROUP BY run_id""",
    ),
)
def genomic_preflight(spark, sf):
    v = T.variants(spark, sf).withColumn(
        "reference", F.when(F.col("row_id") % 997 == 0, "N").otherwise(F.col("reference"))
    )
    v = v.withColumn("variant_id", F.when(F.col("row_id") % 211 == 0, "twice").otherwise(F.col("variant_id")))
    report = Q.preflight(v, T.individuals(spark, sf), T.roles(spark, sf), {"X": [(1, 60000)]})
    return report.withColumn("warnings", F.array_join("warnings", ",")).select(
        "run_id", "records", "duplicate_variant_id", "warnings", "missing_genotypes", "missing_annotations", "unnormalized_allele", "missing_annotation",
        "genotype_quality_missing", "ploidy_mismatch",
    )


@query(
    "d07_input_contexts",
    """WITH s AS (SELECT c_custkey AS run, c_custkey % 12 AS k FROM customer), o AS (SELECT DISTINCT o_custkey AS run FROM orders)
SELECT 'c' || run AS run_id, reason FROM (
  SELECT run, unnest(CASE k WHEN 1 THEN ['unknown_build', 'builds_differ'] WHEN 2 THEN ['builds_differ'] WHEN 3 THEN ['not_normalized'] WHEN 4 THEN ['invalid_reference_checksum']
    WHEN 5 THEN ['transcript_release_not_pinned'] WHEN 6 THEN ['sample_count', 'samples_differ_from_pedigree'] WHEN 7 THEN ['duplicate_samples'] WHEN 8 THEN ['samples_differ_from_pedigree']
    WHEN 9 THEN ['par_intervals_missing'] WHEN 10 THEN ['invalid_par_intervals'] ELSE [] END) AS reason FROM s
  UNION ALL SELECT run, 'no_records' FROM s WHERE run NOT IN (SELECT run FROM o))""",
)
def input_contexts(spark, sf):
    """Every customer is a run with its orders as records; one known fault per residue."""
    k = F.col("c_custkey") % 12
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    span = lambda a, b: F.array(F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")))
    customers = T.read(spark, sf, "customer").select("c_custkey")
    specs = customers.select(
        name.alias("run_id"), F.when(k == 1, "b37").otherwise("GRCh38").alias("genome_build"),
        F.when(k == 2, "GRCh37").otherwise("GRCh38").alias("annotation_build"), (k != 3).alias("normalized_biallelic"),
        F.when(k == 4, "abc").otherwise(F.sha2(name, 256)).alias("reference_checksum"),
        F.when(k == 5, "Latest").otherwise("r110").alias("transcript_release"),
        F.when(k == 6, F.array().cast("array<string>")).when(k == 7, F.array(F.lit("P"), F.lit("M"), F.lit("P")))
        .when(k == 8, F.array(F.lit("P"))).otherwise(F.array(F.lit("P"), F.lit("M"))).alias("sample_ids"),
        F.when(k == 9, F.create_map(F.lit("X"), span(1, 10)))
        .otherwise(F.create_map(F.lit("X"), F.when(k == 10, span(9, 3)).otherwise(span(1, 10)), F.lit("Y"), span(1, 10))).alias("par_intervals"),
    )
    people = customers.select(name.alias("run_id"), F.explode(F.array(F.lit("P"), F.lit("M"))).alias("id"))
    records = T.read(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("run_id"))
    return Q.context_violations(specs, people, records)


@query(
    "d09_context_consistency",
    """WITH s AS (SELECT o_custkey % 200 AS run, CASE WHEN o_orderkey % 997 = 0 THEN 'b37' ELSE 'b38' END AS genome_build,
  CASE WHEN o_orderkey % 1009 = 0 THEN NULL ELSE 'v1' END AS tool_version FROM orders)
SELECT run, CASE WHEN b THEN 'genome_build' ELSE '' END || CASE WHEN b AND t THEN ',' ELSE '' END || CASE WHEN t THEN 'tool_version' ELSE '' END AS fields FROM (
  SELECT run, min(genome_build) <> max(genome_build) AS b, count(*) FILTER (WHERE tool_version IS NULL) > 0 AS t FROM s GROUP BY run) WHERE b OR t""",
)
def context_consistency(spark, sf):
    k = F.col("o_orderkey")
    sources = T.read(spark, sf, "orders").select(
        (F.col("o_custkey") % 200).alias("run"),
        F.when(k % 997 == 0, "b37").otherwise("b38").alias("genome_build"),
        F.when(k % 1009 != 0, "v1").alias("tool_version"),
    )
    found = Q.mixed_contexts(sources, ["genome_build", "tool_version"], "run")
    return found.withColumn("fields", F.array_join("fields", ","))
