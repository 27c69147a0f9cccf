"""Text inputs rendered from the derived tables, so that parsing them has a known result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom import constants as K
from varloom.sources.blocked import write_blocks
from workload import shared as S
from workload import tables as T
from workload.registry import scratch

HEADER = [
    "##fileformat=VCFv4.2",
    "\t".join([*K.VCF_COLUMNS, "P", "M", "F"]),
]


def header_lines(spark, sf, lines: list[str]) -> DataFrame:
    """The given header lines for the file of every run."""
    rows = F.array(*[F.struct(F.lit(i).cast("bigint").alias("line_no"), F.lit(x).alias("value")) for i, x in enumerate(lines, 1)])
    return T.derived(spark, sf, "runs").select(
        F.concat("run_id", F.lit(".vcf")).alias("path"), F.explode(rows).alias("x")
    ).select("path", "x.*")


def chrom():
    """Written chromosome: every second record carries the ``chr`` prefix."""
    return F.concat(F.when(F.col("row_id") % 2 == 0, "chr").otherwise(""), F.col("chromosome"))


def alt_text():
    """Every fifth record has a second ALT."""
    return F.concat(
        F.col("alternate"), F.when(F.col("row_id") % 5 == 0, F.concat(F.lit(","), F.lit("T"), F.col("alternate"))).otherwise("")
    )


def sample_text(gt: str, gq: str, vaf: str | None = None):
    value = F.concat_ws(
        ":", F.col(gt), F.coalesce(F.col(gq).cast("string"), F.lit(".")),
        F.coalesce(F.col(vaf).cast("string"), F.lit(".")) if vaf else F.lit("."),
    )
    return value


def info_text():
    def item(key: str, value):
        return F.when(value.isNotNull(), F.concat(F.lit(f"{key}="), value))

    af = F.col("allele_frequency").cast("string")
    both = F.when(F.col("row_id") % 5 == 0, F.concat(af, F.lit(","), F.lit("0.5"))).otherwise(af)
    return F.concat_ws(
        ";",
        item("GENE", F.col("gene")),
        item("CONSEQUENCE", F.col("consequence")),
        item("AF", both),
        item("CADD", F.col("cadd_score").cast("string")),
        item("CLNSIG", F.col("clinvar_classification")),
        F.lit("DB"),
    )


def record_lines(spark, sf) -> DataFrame:
    return T.once(spark, sf, "record_lines", lambda: _record_lines(spark, sf))


def _record_lines(spark, sf) -> DataFrame:
    flat = T.variants(spark, sf)
    fields = [
        chrom(),
        F.col("position").cast("string"),
        F.when(F.col("row_id") % 3 == 0, ".").otherwise(F.col("variant_id")),
        F.col("reference"),
        alt_text(),
        F.coalesce(F.col("quality").cast("string"), F.lit(".")),
        F.lit("PASS"),
        info_text(),
        F.lit("GT:GQ:VAF"),
        sample_text("genotype", "p_gq", "p_vaf"),
        sample_text("m_gt", "m_gq"),
        sample_text("f_gt", "f_gq"),
    ]
    return flat.select(
        F.concat("run_id", F.lit(".vcf")).alias("path"),
        (F.col("row_id") + 100).alias("line_no"),
        F.concat_ws("\t", *fields).alias("value"),
    )


def vcf_lines(spark, sf) -> DataFrame:
    return header_lines(spark, sf, HEADER).unionByName(record_lines(spark, sf))


#: Compressed bytes of one task in the queries that read the files.
SPLIT = 1 << 17


def vcf_files(spark, sf, header: list[str] = HEADER) -> str:
    """Folder with one block-compressed file per run."""
    path = scratch(spark, "vcf")
    lines = header_lines(spark, sf, header)
    write_blocks(lines.unionByName(record_lines(spark, sf)), path)
    return path


def file_name():
    """Name of a read file without folder and compression."""
    return F.regexp_extract("path", r"([^/]+)\.gz$", 1)


CSQ_LAYOUT = ["Allele", "Consequence", "SYMBOL", "Gene", "Feature", "ALLELE_NUM", "gnomADe_AF", "gnomADg_AF"]


def csq_text():
    """Two or three consequence entries in one or two genes, some with frequencies."""
    g = F.col("g").cast("string")
    af = F.col("allele_frequency").cast("string")

    def entry(term, symbol, gene, feature, e, other):
        return F.concat_ws("|", F.col("alternate"), term, symbol, gene, feature, F.lit("1"), e, other)

    blank = F.lit("")
    first = entry(
        F.coalesce("consequence", F.lit("intron_variant")),
        F.coalesce("gene", blank),
        F.concat(F.lit("E"), g),
        F.concat(F.lit("T"), g, F.lit("a")),
        F.coalesce(af, blank),
        blank,
    )
    second = entry(
        F.lit("synonymous_variant&splice_donor_variant"),
        F.coalesce("gene", blank),
        F.concat(F.lit("E"), g),
        F.concat(F.lit("T"), g, F.lit("b")),
        blank,
        F.when(F.col("row_id") % 4 == 0, F.coalesce(af, blank)).otherwise(blank),
    )
    third = entry(
        F.lit("intron_variant"), blank, F.concat(F.lit("N"), g), F.concat(F.lit("T"), g, F.lit("c")), blank, blank
    )
    return F.when(F.col("row_id") % 6 == 0, ".").when(
        F.col("row_id") % 6 == 1, F.concat_ws(",", first, second, third)
    ).otherwise(F.concat_ws(",", first, second))


def annotated_fields(spark, sf, with_csq: bool = True) -> DataFrame:
    """(run_id, f): fields of normalized one-allele records with source tags."""
    name = "annotated" if with_csq else "normalized"
    return T.once(spark, sf, name, lambda: _annotated_fields(spark, sf, with_csq))


def _annotated_fields(spark, sf, with_csq: bool) -> DataFrame:
    flat = T.variants(spark, sf).withColumn("g", F.expr("pk div 5"))
    tags = F.concat(
        F.lit(f"DP=9;{K.SOURCE_ROW_TAG}="), F.col("row_id").cast("string"), F.lit(f";{K.SOURCE_ALT_TAG}=1")
    )
    info = F.concat_ws(";", tags, F.concat(F.lit("CSQ="), csq_text())) if with_csq else tags
    fields = [
        F.col("chromosome"),
        F.col("position").cast("string"),
        F.lit("."),
        F.col("reference"),
        F.col("alternate"),
        F.coalesce(F.col("quality").cast("string"), F.lit(".")),
        F.lit("PASS"),
        info,
        F.lit("GT:GQ"),
        F.concat_ws(":", "genotype", F.coalesce(F.col("p_gq").cast("string"), F.lit("."))),
    ]
    return flat.select("run_id", F.array(*fields).alias("f"))


def obo_lines(spark, sf) -> DataFrame:
    """Ontology text of the derived terms; a block of 10 line numbers per term."""
    rows = S.terms(spark, sf).select(
        "k",
        F.concat(
            F.array(F.lit("[Term]"), F.concat(F.lit("id: "), "hpo_id"), F.concat(F.lit("name: "), "label")),
            F.transform("parents", lambda p: F.concat(F.lit("is_a: "), p, F.lit(" ! parent"))),
            F.when(F.col("obsolete"), F.array(F.lit("is_obsolete: true"))).otherwise(F.array().cast("array<string>")),
            F.when(
                F.col("replaced_by").isNotNull(), F.array(F.concat(F.lit("replaced_by: "), "replaced_by"))
            ).otherwise(F.array().cast("array<string>")),
            F.array(F.lit("! comment"), F.lit("")),
        ).alias("ls"),
    )
    return rows.select(F.lit("hp.obo").alias("path"), "k", F.posexplode("ls").alias("i", "value")).select(
        "path", (F.col("k") * 10 + F.col("i")).alias("line_no"), "value"
    )


def obo_files(spark, sf) -> str:
    """Ontology text as a few files."""
    path = scratch(spark, "obo")
    lines = obo_lines(spark, sf).withColumn("k", F.expr("line_no div 10"))
    lines.repartitionByRange(4, "k").sortWithinPartitions("line_no").select("value").write.text(path)
    return path


def _write_tsv(rows: DataFrame, path: str) -> None:
    """Tab-separated files with a header each, added to the folder."""
    # a first name that starts with the comment character would be quoted
    rows.write.mode("append").option("comment", "\x01").csv(path, sep="\t", header=True, quote="", escape="", emptyValue="")


def association_files(spark, sf) -> str:
    """Small-form association files; a part of them has the columns in another order."""
    path = scratch(spark, "associations")
    named = S.associations(spark, sf).select(
        "k", F.lower("gene").alias("Gene"), F.col("hpo_id").alias("HPO-ID"), "disease_id",
        F.col("evidence").alias("frequency"),
    )
    _write_tsv(named.where("k % 3 <> 0").drop("k"), path)
    _write_tsv(named.where("k % 3 = 0").select("frequency", "disease_id", "HPO-ID", "Gene"), path)
    return path


def official_files(spark, sf) -> str:
    """Official association files; the header starts with a comment sign."""
    path = scratch(spark, "official")
    rows = S.associations(spark, sf).select(
        F.col("k").cast("string").alias("#ncbi_gene_id"), F.col("gene").alias("gene_symbol"), "hpo_id", "qualifier",
        "disease_id", "evidence",
    )
    _write_tsv(rows, path)
    return path
