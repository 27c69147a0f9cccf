"""Genotype expressions. Every function takes and returns Columns; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.session import dbl

CALL_TYPE = T.StructType(
    [
        T.StructField("genotype", T.StringType()),
        T.StructField("quality", T.DoubleType()),
        T.StructField("alternate_fraction", T.DoubleType()),
    ]
)
CALLS_TYPE = T.MapType(T.StringType(), CALL_TYPE)
CALL_PATTERN = r"^[0-9.]+([/|][0-9.]+)?$"


def alleles(gt: Column) -> Column:
    """Allele tokens of a call; an empty array for a missing call."""
    missing = gt.isNull() | gt.isin(".", "./.", ".|.")
    return F.when(missing, F.array().cast("array<string>")).otherwise(F.split(gt, "[/|]"))


def gt_called(gt: Column) -> Column:
    """A call without a missing token. Calls have one or two tokens (``CALL_PATTERN``)."""
    missing = (
        (gt == ".")
        | gt.startswith("./")
        | gt.startswith(".|")
        | gt.endswith("/.")
        | gt.endswith("|.")
    )
    return gt.isNotNull() & ~F.coalesce(missing, F.lit(True))


def gt_is_ref(gt: Column) -> Column:
    return F.coalesce(gt.isin("0", "0/0", "0|0"), F.lit(False))


def gt_has_alt(gt: Column) -> Column:
    return gt_called(gt) & ~gt_is_ref(gt)


def _ends(gt: Column) -> tuple[Column, Column, Column]:
    """First token, last token, and whether the call has two tokens."""
    slashed = F.translate(gt, "|", "/")
    return (
        F.substring_index(slashed, "/", 1),
        F.substring_index(slashed, "/", -1),
        slashed.contains("/"),
    )


def gt_is_het(gt: Column) -> Column:
    first, last, two = _ends(gt)
    return gt_called(gt) & F.coalesce(two & (first != last), F.lit(False))


def gt_is_hom_alt(gt: Column) -> Column:
    first, last, two = _ends(gt)
    return gt_called(gt) & F.coalesce(two & (first == last) & (first != "0"), F.lit(False))


def checked_genotype(gt: Column) -> Column:
    """The call itself; a call outside the supported syntax stops the job."""
    return F.when(
        gt.isNotNull() & ~gt.rlike(CALL_PATTERN),
        F.raise_error(F.concat(F.lit("unsupported genotype: "), gt)).cast("string"),
    ).otherwise(gt)


def zygosity(gt: Column) -> Column:
    """Zygosity label of a call; NULL when the call is missing."""
    tokens = F.split(gt, "[/|]")
    first = F.get(tokens, F.lit(0))
    return (
        F.when(gt.isNull() | gt.isin("", ".", "./.", ".|."), F.lit(None).cast("string"))
        .when(
            F.size(tokens) == 1,
            F.when(first != "0", F.lit("hemizygous")).otherwise(F.lit("reference")),
        )
        .when(F.forall(tokens, lambda a: a == "0"), F.lit("reference"))
        .when(F.size(F.array_distinct(tokens)) == 1, F.lit("homozygous_alternate"))
        .when(F.array_contains(tokens, "0"), F.lit("heterozygous"))
        .otherwise(F.lit("compound_alternate"))
    )


def genotype_state(gt: Column) -> Column:
    """State of a saved one-allele call (tokens 0, 1 and . only); others stop the job."""
    tokens = F.split(gt, "[/|]")
    return (
        F.when(gt.isNull(), F.lit("unknown"))
        .when(
            ~gt.rlike(r"^[01.]([/|][01.])?$"),
            F.raise_error(F.concat(F.lit("unsupported saved genotype: "), gt)).cast("string"),
        )
        .when(F.array_contains(tokens, "."), F.lit("unknown"))
        .when(F.forall(tokens, lambda a: a == "0"), F.lit("reference"))
        .when(F.size(tokens) == 1, F.lit("haploid_alt"))
        .when(F.forall(tokens, lambda a: a == "1"), F.lit("homozygous_alt"))
        .otherwise(F.lit("heterozygous"))
    )


def called_reference(gt: Column) -> Column:
    return F.coalesce(gt.rlike(r"^0([/|]0)?$"), F.lit(False))


def project_gt(gt: Column, alt_index: Column) -> Column:
    """Rewrite a call for one ALT: that index becomes 1, every other number 0."""
    k = alt_index.cast("string")
    marked = F.regexp_replace(gt, F.concat(F.lit(r"(?<!\d)"), k, F.lit(r"(?!\d)")), F.lit("@"))
    zeroed = F.regexp_replace(marked, F.lit(r"\d+"), F.lit("0"))
    return F.regexp_replace(zeroed, F.lit("@"), F.lit("1"))


def call_struct(gt: Column, quality: Column, fraction: Column) -> Column:
    return F.struct(
        gt.cast("string").alias("genotype"),
        quality.cast("double").alias("quality"),
        fraction.cast("double").alias("alternate_fraction"),
    )


def parse_calls(json_text: Column) -> Column:
    """Typed call map from its JSON text form."""
    return F.from_json(json_text, CALLS_TYPE)


def call_of(calls: Column, sample: Column) -> Column:
    """Call of one sample; NULL when the sample is unset or absent."""
    return F.when(sample.isNotNull(), calls[sample])


def call_passes_quality(call: Column, min_quality: float, min_fraction: float) -> Column:
    """False when a called sample has low quality or a low alternate fraction.

    A missing call, quality or fraction passes.
    """
    gt = call["genotype"]
    low = gt_called(gt) & (
        F.coalesce(call["quality"] < dbl(min_quality), F.lit(False))
        | (gt_has_alt(gt) & F.coalesce(call["alternate_fraction"] < dbl(min_fraction), F.lit(False)))
    )
    return ~low
