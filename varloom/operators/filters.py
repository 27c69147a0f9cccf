"""Variant predicates. Each is a Column, so it reaches the scan wherever it is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.session import dbl


def quality_at_least(minimum: float) -> Column:
    return F.col("quality").isNull() | (F.col("quality") >= dbl(minimum))


def rare(maximum: float, rescue: bool = True) -> Column:
    """Unknown or low frequency; with ``rescue`` also anything labelled pathogenic."""
    if not 0 < maximum <= 0.05:
        raise ValueError("frequency threshold must be in (0, 0.05]")
    keep = F.col("allele_frequency").isNull() | (F.col("allele_frequency") <= dbl(maximum))
    if rescue:
        label = F.lower(F.coalesce("clinvar_classification", F.lit("")))
        keep = keep | label.contains("pathogenic")
    return keep


def consequence_in(terms: list[str]) -> Column:
    if not terms:
        raise ValueError("give a consequence")
    return F.coalesce(F.col("consequence").isin(*sorted(set(terms))), F.lit(False))


def gene_in(genes: list[str]) -> Column:
    names = sorted({g.upper() for g in genes})
    if not names:
        raise ValueError("give a gene; a list held in a table goes to filter_gene_table")
    return F.upper(F.coalesce("gene", F.lit(""))).isin(*names)


def filter_gene_table(df: DataFrame, genes: DataFrame) -> DataFrame:
    """Gene filter for a list held in a table (column ``gene``)."""
    names = genes.select(F.upper("gene").alias("_g")).distinct()
    return df.join(names, F.upper(F.coalesce(df["gene"], F.lit(""))) == names["_g"], "left_semi")


def clinvar_in(labels: list[str]) -> Column:
    names = sorted({x.lower() for x in labels})
    return F.lower(F.coalesce("clinvar_classification", F.lit(""))).isin(*names)


def filter_variants(
    df: DataFrame,
    limit: int,
    maximum_frequency: float | None = None,
    rescue: bool = True,
    minimum_cadd: float | None = None,
    genes: list[str] | None = None,
    consequences: list[str] | None = None,
) -> DataFrame:
    """Ad-hoc conjunction in chromosome (text) and position order, first ``limit`` rows.

    Unknown frequency passes, unknown CADD does not; the gene match is case sensitive.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if maximum_frequency is not None:
        keep = F.col("allele_frequency").isNull() | (
            F.col("allele_frequency") <= dbl(maximum_frequency)
        )
        if rescue:
            keep = keep | F.lower("clinvar_classification").contains("pathogenic")
        df = df.where(keep)
    if minimum_cadd is not None:
        df = df.where(F.col("cadd_score") >= dbl(minimum_cadd))
    if genes:
        df = df.where(F.col("gene").isin(*genes))
    if consequences:
        df = df.where(F.col("consequence").isin(*consequences))
    return df.orderBy("chromosome", "position").limit(limit)
