"""VCF text: scan, header checks, and one row per allele."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom import constants as K
from varloom.functions import fields
from varloom.functions import genotype as G
from varloom.operators.ordering import line_ordinals
from varloom.session import require_empty
from varloom.sources.blocked import SPLIT_BYTES, read_blocks

FORMAT_PREFIX = "##fileformat=VCF"
SAMPLE_PREFIX = "#CHROM"


def read_lines(
    spark: SparkSession, paths: str | list[str], block_compressed: bool = False, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """(path, line_no, value) of text files, plain or ``.gz``.

    Plain files split. A gzip file is one task, unless it is block-compressed and read
    as such: then every ``split_bytes`` of it are a task.
    """
    if block_compressed:
        raw = read_blocks(spark, paths, split_bytes)
    else:
        raw = spark.read.text(paths).select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block_start"), "value"
        )
    # inflating takes a Python pass, and checks and line numbers each read the lines
    return line_ordinals(raw.withColumn("value", F.regexp_replace("value", "\\r$", "")), saved=block_compressed)


def long_lines(lines: DataFrame, limit: int = K.MAX_LINE_BYTES) -> DataFrame:
    """Lines above the length limit; never truncated, the caller refuses them."""
    return lines.where(F.length("value") > limit).select("path", "line_no", F.length("value").alias("n"))


def vcf_samples(lines: DataFrame) -> DataFrame:
    """(path, idx, sample): the sample names of each header, idx from 0."""
    return (
        lines.where(F.col("value").startswith(SAMPLE_PREFIX))
        .select("path", F.split("value", "\t").alias("f"))
        .select("path", F.posexplode(F.slice("f", 10, F.size("f"))).alias("idx", "sample"))
    )


def sample_violations(lines: DataFrame, single: bool = False) -> DataFrame:
    """Files with repeated sample names, or (``single``) not exactly one sample."""
    per_file = (
        lines.select("path")
        .distinct()
        .join(
            vcf_samples(lines)
            .groupBy("path")
            .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sample").alias("names")),
            "path",
            "left",
        )
    )
    bad = F.coalesce(F.col("n") != F.col("names"), F.lit(False))
    if single:
        bad = bad | (F.coalesce("n", F.lit(0)) != 1)
    return per_file.where(bad)


def header_violations(lines: DataFrame) -> DataFrame:
    """(path, reason) for files without a format line, a header, or with early records."""
    is_header = F.col("value").startswith(SAMPLE_PREFIX)
    is_record = ~F.col("value").startswith("#") & (F.col("value") != "")
    facts = lines.groupBy("path").agg(
        F.max(F.col("value").startswith(FORMAT_PREFIX)).alias("has_format"),
        F.min(F.when(is_header, F.col("line_no"))).alias("header_at"),
        F.min(F.when(is_record, F.col("line_no"))).alias("record_at"),
    )
    rules = {
        "missing_fileformat": ~F.col("has_format"),
        "missing_header": F.col("header_at").isNull(),
        "record_before_header": F.coalesce(F.col("record_at") < F.col("header_at"), F.lit(False)),
    }
    return facts.select("path", F.explode(fields.reasons(rules)).alias("reason"))


def record_fields(lines: DataFrame) -> DataFrame:
    """Data lines with their tab fields as ``f``."""
    return lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).withColumn(
        "f", F.split("value", "\t")
    )


CALL_FIELDS = ("GT", "GQ", "VAF")


def raw_calls(fmt: Column, values: Column) -> Column:
    """Per sample: struct of the GT, GQ and VAF texts, NULL where absent."""
    keys = F.split(fmt, ":")
    places = {n: F.array_position(keys, F.lit(n)).cast("int") for n in CALL_FIELDS}

    def texts(tokens: Column) -> Column:
        items = []
        for name, at in places.items():
            items += [F.lit(name), F.when(at > 0, F.get(tokens, at - F.lit(1)))]
        return F.named_struct(*items)

    return F.transform(F.transform(values, lambda v: F.split(v, ":")), texts)


def typed_calls(raw: Column, names: Column) -> Column:
    """Map sample -> call from the texts of ``raw_calls``; bad values stop the job."""

    def call(texts: Column) -> Column:
        fraction = fields.checked_number(texts["VAF"])
        return F.named_struct(
            F.lit("genotype"),
            G.checked_genotype(texts["GT"]),
            F.lit("quality"),
            fields.checked_number(texts["GQ"]),
            F.lit("alternate_fraction"),
            F.when(
                fraction.isNotNull() & ~fraction.between(0, 1),
                F.raise_error(F.lit("alternate fraction outside 0..1")).cast("double"),
            ).otherwise(fraction),
        )

    return F.map_from_arrays(
        F.slice(names, 1, F.size(raw)), F.transform(F.slice(raw, 1, F.size(names)), call)
    )


def genotype_calls(fmt: Column, values: Column, names: Column) -> Column:
    """Map sample -> call from the FORMAT text and the sample columns."""
    return typed_calls(raw_calls(fmt, values), names)


def split_alleles(lines: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """One row per ALT of every record, with typed annotations and calls.

    ``samples`` is (path, names array); by default it is taken from the headers.
    """
    if samples is None:
        samples = (
            vcf_samples(lines)
            .groupBy("path")
            .agg(F.array_sort(F.collect_list(F.struct("idx", "sample"))).alias("_s"))
            .select("path", F.transform("_s", lambda x: x["sample"]).alias("names"))
        )
    records = record_fields(lines).join(samples, "path", "left")
    short = F.size("f") < 8
    f = F.when(short, F.raise_error(F.lit("a record needs 8 columns")).cast("array<string>")).otherwise(
        F.col("f")
    )
    parsed = records.select(
        "path",
        "line_no",
        f.alias("f"),
        F.coalesce("names", F.array().cast("array<string>")).alias("names"),
        fields.info_map(F.get("f", F.lit(7))).alias("info"),
        F.split(F.get("f", F.lit(4)), ",").alias("alts"),
        F.slice(f, 10, F.size(f)).alias("values"),
    )
    col = lambda i: F.get("f", F.lit(i))
    position = col(1).try_cast("bigint")
    has_samples = (F.size("values") > 0) & (F.size("names") > 0)
    base = parsed.withColumn("_raw", raw_calls(col(8), F.col("values"))).select(
        "path",
        "line_no",
        col(0).alias("chrom"),
        F.when(position > 0, position)
        .otherwise(F.raise_error(F.concat(F.lit("invalid position: "), col(1))).cast("bigint"))
        .alias("position"),
        col(2).alias("identifier"),
        col(3).alias("reference"),
        F.size("alts").alias("n_alt"),
        fields.checked_number(col(5)).alias("quality"),
        "info",
        F.get("_raw", F.lit(0))["GT"].alias("genotype"),
        F.when(has_samples, typed_calls(F.col("_raw"), F.col("names"))).alias("calls"),
        F.posexplode("alts").alias("alt_index", "alternate"),
    )

    def text(*names: str) -> Column:
        """First present and non-empty key; a single key is taken as it is."""
        if len(names) == 1:
            return F.col("info")[names[0]]
        return F.coalesce(
            *[F.nullif(F.col("info")[n], F.lit("")) for n in names[:-1]], F.col("info")[names[-1]]
        )

    def number(name: str) -> Column:
        return fields.checked_number(
            fields.per_allele(F.col("info")[name], F.col("alt_index"), F.col("n_alt"))
        )

    return base.select(
        "path",
        "line_no",
        fields.strip_chr(F.col("chrom")).alias("chromosome"),
        "position",
        "reference",
        "alternate",
        fields.variant_id(
            F.col("identifier"),
            F.col("chrom"),
            F.col("position"),
            F.col("reference"),
            F.col("alternate"),
            F.col("n_alt"),
        ).alias("variant_id"),
        text("GENE").alias("gene"),
        text("TRANSCRIPT").alias("transcript"),
        text("CONSEQUENCE", "CSQ").alias("consequence"),
        text("PROTEIN_CHANGE", "HGVSP").alias("protein_change"),
        "genotype",
        "quality",
        number("AF").alias("allele_frequency"),
        text("CLNSIG").alias("clinvar_classification"),
        number("CADD").alias("cadd_score"),
        number("REVEL").alias("revel_score"),
        number("ALPHAMISSENSE").alias("alphamissense_score"),
        G.zygosity(F.col("genotype")).alias("zygosity"),
        text("INHERITANCE").alias("inheritance_information"),
        "calls",
        fields.checked_number(F.col("info")["PHENOTYPE_SCORE"]).alias("phenotype_score"),
        fields.checked_number(F.col("info")["EVIDENCE_SCORE"]).alias("evidence_score"),
        "alt_index",
    )


def read_vcf(
    spark: SparkSession, paths: str | list[str], check: bool = True, block_compressed: bool = False,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Allele rows of VCF files, in ``line_no`` and ``alt_index`` order per path."""
    lines = read_lines(spark, paths, block_compressed, split_bytes)
    if check:
        require_empty(long_lines(lines), "line above the length limit")
        require_empty(header_violations(lines), "malformed VCF header")
        require_empty(sample_violations(lines), "duplicate sample names")
    return split_alleles(lines)


def contig_statistics(lines: DataFrame, check: bool = True) -> DataFrame:
    """(path, name, length, records) of contigs with records, from headers and data lines."""
    header = lines.where(F.col("value").startswith("##contig=<")).select(
        "path",
        F.regexp_extract("value", "(?:<|,)ID=([^,>]+)", 1).alias("name"),
        F.regexp_extract("value", r"(?:<|,)length=(\d+)(?:,|>)", 1).try_cast("bigint").alias("length"),
    )
    counts = (
        lines.where(~F.col("value").startswith("#") & (F.col("value") != ""))
        .groupBy("path", F.substring_index("value", "\t", 1).alias("name"))
        .agg(F.count(F.lit(1)).alias("records"))
    )
    if check:
        require_empty(header.where("length is null or name = ''"), "contig without name or length")
        require_empty(
            header.groupBy("path", "name").count().where("count > 1"), "contig declared twice"
        )
        require_empty(
            counts.join(header, ["path", "name"], "left_anti"), "record without declared contig"
        )
    return counts.join(header, ["path", "name"]).select("path", "name", "length", "records")
