"""Text field expressions: INFO maps, per-allele values, numbers, contigs, ids, hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from varloom import constants as K

def null_string() -> Column:
    return F.lit(None).cast("string")


def blank(value: Column) -> Column:
    return value.isNull() | value.isin("", ".")


def info_map(info: Column, strict: bool = False) -> Column:
    """``k=v;flag`` text as a map.

    Loose form: a flag is ``true`` and the last duplicate wins. Strict form: a
    flag is empty and a duplicate key stops the job (the default rule of the
    map functions).
    """
    plain = F.transform_values(
        F.str_to_map(info, F.lit(";"), F.lit("=")),
        lambda k, v: F.coalesce(v, F.lit("" if strict else "true")),
    )
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    if strict:
        return F.when(info.isNull() | info.isin("", "."), empty).otherwise(plain)
    items = F.split(info, ";")
    keys = F.transform(items, _before_eq)

    def value(token: Column) -> Column:
        return F.when(F.instr(token, "=") > 0, _after_eq(token)).otherwise(F.lit("true"))

    last = F.filter(
        items,
        lambda t, i: ~F.exists(
            F.slice(items, i + 2, F.size(items)), lambda later: _before_eq(later) == _before_eq(t)
        ),
    )
    deduplicated = F.map_from_arrays(F.transform(last, _before_eq), F.transform(last, value))
    return (
        F.when(info.isNull() | info.isin("", "."), empty)
        .when(F.size(F.array_distinct(keys)) < F.size(keys), deduplicated)
        .otherwise(plain)
    )


def _before_eq(token: Column) -> Column:
    return F.substring_index(token, "=", 1)


def _after_eq(token: Column) -> Column:
    return F.substring(token, F.instr(token, "=") + F.lit(1), F.length(token))


def per_allele(raw: Column, index: Column, n_alt: Column) -> Column:
    """Value of one ALT when the comma list has one entry per ALT, else the raw text."""
    values = F.split(raw, ",")
    return F.when(F.size(values) == n_alt, F.get(values, index)).otherwise(raw)


def checked_number(raw: Column, strict: bool = False) -> Column:
    """Double value; NULL for blank text, an error for text that is not a number.

    The strict form also refuses negative, NaN and infinite values.
    """
    number = raw.try_cast("double")
    bad = number.isNull()
    if strict:
        bad = bad | F.isnan(number) | (F.abs(number) == F.lit(float("inf"))) | (number < 0)
    return (
        F.when(blank(raw), F.lit(None).cast("double"))
        .when(bad, F.raise_error(F.concat(F.lit("not a valid number: "), raw)).cast("double"))
        .otherwise(number)
    )


def is_valid_number(raw: Column, strict: bool = False) -> Column:
    """True when ``checked_number`` would accept the text."""
    number = raw.try_cast("double")
    ok = number.isNotNull()
    if strict:
        ok = ok & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))) & (number >= 0)
    return blank(raw) | ok


def strip_chr(name: Column) -> Column:
    return F.regexp_replace(name, F.lit("^chr"), F.lit(""))


def canonical_contig(name: Column) -> Column:
    """Standard contig name, or NULL for one outside the standard set."""
    bare = strip_chr(name)
    target = F.when(bare == "M", F.lit("MT")).otherwise(bare)
    return F.when(target.isin(*K.STANDARD_CONTIGS), target)


def present_chrom(name: Column) -> Column:
    """Presentation name (``chr`` + 1-22, X, Y); any other name stops the job."""
    bare = strip_chr(name)
    return F.when(
        bare.isin(*K.AUTOSOMES, "X", "Y"), F.concat(F.lit("chr"), bare)
    ).otherwise(
        F.raise_error(F.concat(F.lit("chromosome has no presentation name: "), name)).cast("string")
    )


def variant_id(identifier: Column, chrom: Column, pos: Column, ref: Column, alt: Column,
               n_alt: Column) -> Column:
    return (
        F.when(identifier.isin("", "."), F.concat_ws("-", chrom, pos.cast("string"), ref, alt))
        .when(n_alt > 1, F.concat_ws(":", identifier, alt))
        .otherwise(identifier)
    )


def allele_id(source_row: Column, source_alt: Column) -> Column:
    return F.concat(
        F.lit("r"), source_row.cast("string"), F.lit("_a"), source_alt.cast("string")
    )


def candidate_key(allele: Column, gene_id: Column) -> Column:
    return F.concat(allele, F.lit("_g"), F.substring(F.sha2(gene_id, 256), 1, 16))


def record_identity(fields: Column, source_row: Column, source_alt: Column) -> Column:
    """Digest of a record without its INFO text, which annotation may extend."""
    kept = F.concat(F.slice(fields, 1, 7), F.slice(fields, 9, F.size(fields)))
    return F.sha2(F.to_json(F.struct(kept.alias("f"), source_row.alias("r"), source_alt.alias("a"))), 256)


def coordinate_key(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """Coordinates up to ``chr`` prefix and letter case."""
    return F.struct(
        F.upper(F.regexp_replace(chrom, F.lit("(?i)^chr"), F.lit(""))).alias("chrom"),
        pos.cast("bigint").alias("pos"),
        F.upper(ref).alias("ref"),
        F.upper(alt).alias("alt"),
    )


def pseudonym(identifier: Column, salt: bytes) -> Column:
    """``candidate-`` + 16 hex digits of HMAC-SHA256(salt, id), built from two digests."""
    if len(salt) < 16:
        raise ValueError("salt must have at least 16 bytes")
    import hashlib

    block = hashlib.sha256(salt).digest() if len(salt) > 64 else salt
    block = block.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in block))
    outer = F.lit(bytearray(b ^ 0x5C for b in block))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(identifier, "UTF-8")), 256))
    return F.concat(
        F.lit("candidate-"), F.substring(F.sha2(F.concat(outer, digest), 256), 1, 16)
    )


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def reasons(rules: dict[str, Column]) -> Column:
    """Array with the names of the rules that hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
