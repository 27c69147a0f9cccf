"""Pedigree-based inheritance evidence, one projection per variant row.

Input rows carry ``calls`` (sample -> call) and are joined to one pedigree row
per run. All models of a variant are computed in the same row, so nothing is
shuffled apart from the pedigree join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom import constants as K
from varloom.functions import fields
from varloom.functions import genotype as G
from varloom.operators.ordering import checked_broadcast
from varloom.session import dbl, materialize


def pedigree_table(individuals: DataFrame, roles: DataFrame) -> DataFrame:
    """One row per run: roles, proband sex, status of the trio, and the other people.

    The array holds the people of one case. The trio is kept
    in plain columns: its share of every model is then generated code.
    """
    people = individuals.groupBy("run_id").agg(
        F.collect_list(F.struct("id", "sex", "affected")).alias("_people")
    )
    joined = roles.join(people, "run_id")

    def person(role: str) -> Column:
        return F.get(F.filter("_people", lambda p: p["id"] == F.col(role)), F.lit(0))

    trio = F.array("proband_id", "mother_id", "father_id")
    return joined.select(
        "run_id",
        "proband_id",
        "mother_id",
        "father_id",
        person("proband_id")["sex"].alias("proband_sex"),
        person("proband_id")["affected"].alias("proband_affected"),
        person("mother_id")["affected"].alias("mother_affected"),
        person("father_id")["affected"].alias("father_affected"),
        F.filter(
            "_people", lambda p: ~F.coalesce(F.array_contains(trio, p["id"]), F.lit(False))
        ).alias("others"),
    )


def with_trio(
    variants: DataFrame,
    pedigree: DataFrame,
    min_quality: float = K.MIN_GENOTYPE_QUALITY,
    min_fraction: float = K.MIN_ALTERNATE_FRACTION,
) -> DataFrame:
    """Attach the three calls and the facts about them that the models share."""
    # one row per run: broadcast after its size is known, so variants keep their partitioning
    joined = variants.join(checked_broadcast(materialize(pedigree)), "run_id")
    calls = joined.select(
        *variants.columns,
        "others",
        "proband_sex",
        "proband_affected",
        "mother_affected",
        "father_affected",
        G.call_of(F.col("calls"), F.col("proband_id")).alias("_p"),
        G.call_of(F.col("calls"), F.col("mother_id")).alias("_m"),
        G.call_of(F.col("calls"), F.col("father_id")).alias("_f"),
    )
    flags = calls.select(
        "*",
        *[
            expr(F.col(f"_{who}.genotype")).alias(f"_{who}_{name}")
            for who in "pmf"
            for name, expr in (
                ("called", G.gt_called),
                ("alt", G.gt_has_alt),
                ("ref", G.gt_is_ref),
                ("het", G.gt_is_het),
            )
        ],
        G.gt_is_hom_alt(F.col("_p.genotype")).alias("_p_hom"),
        *[
            G.call_passes_quality(F.col(f"_{who}"), min_quality, min_fraction).alias(f"_{who}_ok")
            for who in "pmf"
        ],
    )
    others_ok = (F.size("others") == 0) | F.forall(
        "others",
        lambda o: G.call_passes_quality(F.col("calls")[o["id"]], min_quality, min_fraction),
    )
    trio_ok = F.col("_p_ok") & F.col("_m_ok") & F.col("_f_ok")
    return flags.select(
        "*", trio_ok.alias("trio_quality"), (trio_ok & others_ok).alias("pedigree_quality")
    )


def parents_called() -> Column:
    return F.col("_m_called") & F.col("_f_called")


def de_novo_fit() -> Column:
    return (
        F.when(~F.col("_p_alt"), dbl(0))
        .when(~parents_called(), dbl(0.4))
        .when(F.col("_m_ref") & F.col("_f_ref"), dbl(1))
        .otherwise(dbl(0))
    )


def hom_recessive_fit() -> Column:
    return (
        F.when(~F.col("_p_hom"), dbl(0))
        .when(~parents_called(), dbl(0.65))
        .when(F.col("_m_het") & F.col("_f_het"), dbl(1))
        .otherwise(dbl(0.35))
    )


def x_linked_fit() -> Column:
    on_x = F.regexp_replace(F.upper("chromosome"), F.lit("^CHR"), F.lit("")) == "X"
    return (
        F.when(~F.coalesce(on_x, F.lit(False)), dbl(0))
        .when(~F.coalesce(F.col("proband_sex") == "male", F.lit(False)), dbl(0.2))
        .when(~F.col("_p_alt"), dbl(0))
        .when(
            F.col("_m_het"),
            F.when(F.col("_f").isNull() | F.col("_f_ref"), dbl(1)).otherwise(dbl(0.9)),
        )
        .otherwise(dbl(0.55))
    )


def dominant_facts() -> Column:
    """Struct of informative and consistent calls, and whether a relative carries."""
    seen_others = F.filter(
        F.transform(
            "others",
            lambda o: F.struct(
                o["affected"].alias("affected"), F.col("calls")[o["id"]]["genotype"].alias("gt")
            ),
        ),
        lambda s: s["affected"].isNotNull() & G.gt_called(s["gt"]),
    )
    has_others = F.size("others") > 0

    def fits(affected: Column, alt: Column, ref: Column) -> Column:
        return F.when(affected, alt).otherwise(ref)

    status = {
        who: F.col(f"{name}_affected")
        for who, name in (("p", "proband"), ("m", "mother"), ("f", "father"))
    }
    seen = {w: F.coalesce(F.col(f"_{w}_called"), F.lit(False)) & s.isNotNull() for w, s in status.items()}
    good = {w: seen[w] & fits(s, F.col(f"_{w}_alt"), F.col(f"_{w}_ref")) for w, s in status.items()}
    carrier = (seen["m"] & status["m"] & F.col("_m_alt")) | (
        seen["f"] & status["f"] & F.col("_f_alt")
    )
    return F.struct(
        (
            sum((x.cast("int") for x in seen.values()), F.lit(0))
            + F.when(has_others, F.size(seen_others)).otherwise(0)
        ).alias("informative"),
        (
            sum((x.cast("int") for x in good.values()), F.lit(0))
            + F.when(
                has_others,
                F.size(
                    F.filter(
                        seen_others,
                        lambda s: fits(s["affected"], G.gt_has_alt(s["gt"]), G.gt_is_ref(s["gt"])),
                    )
                ),
            ).otherwise(0)
        ).alias("consistent"),
        (
            carrier
            | (
                has_others
                & F.exists(seen_others, lambda s: s["affected"] & G.gt_has_alt(s["gt"]))
            )
        ).alias("carrier_relative"),
    )


def dominant_fit() -> Column:
    facts = F.col("_dominant")
    share = F.when(
        facts["informative"] > 0,
        facts["consistent"].cast("double") / facts["informative"].cast("double"),
    ).otherwise(dbl(0.5))
    supported = facts["carrier_relative"] | (F.col("_m_ref") & F.col("_f_ref"))
    return F.when(~F.col("_p_alt"), dbl(0)).otherwise(
        F.when(supported, share).otherwise(F.least(share, dbl(0.5)))
    )


def apply_caps(fit: Column, quality_ok: Column) -> Column:
    """Cap at 0.5 on failed quality checks or unknown proband status; 4 digits."""
    capped = F.when(quality_ok & F.col("proband_affected").isNotNull(), fit).otherwise(
        F.least(fit, dbl(0.5))
    )
    return F.round(capped, 4)


def parental_origin() -> Column:
    return (
        F.when(~parents_called(), F.lit("unknown"))
        .when(F.col("_m_alt") & F.col("_f_ref"), F.lit("maternal"))
        .when(F.col("_f_alt") & F.col("_m_ref"), F.lit("paternal"))
        .otherwise(F.lit("unknown"))
    )


def single_fits(trio: DataFrame) -> DataFrame:
    """Add the capped fit of every single-variant model as a column."""
    facts = trio.withColumn("_dominant", dominant_facts())
    fitted = facts.select(
        "*",
        apply_caps(de_novo_fit(), F.col("trio_quality")).alias("de_novo"),
        apply_caps(dominant_fit(), F.col("pedigree_quality")).alias("autosomal_dominant"),
        apply_caps(hom_recessive_fit(), F.col("trio_quality")).alias("homozygous_recessive"),
        apply_caps(x_linked_fit(), F.col("trio_quality")).alias("x_linked"),
        parental_origin().alias("origin"),
    )
    return fitted.withColumn("autosomal_recessive", F.col("homozygous_recessive"))


def model_warnings(model: str) -> Column:
    """Reason codes that keep a fit uncertain."""
    quality = F.col("pedigree_quality" if model == "autosomal_dominant" else "trio_quality")
    facts = F.col("_dominant")
    no_alt = ~F.col("_p_alt")
    rules: dict[str, dict[str, Column]] = {
        "de_novo": {
            "proband_without_called_alternate": no_alt,
            "parents_incomplete": ~no_alt & ~parents_called(),
        },
        "autosomal_dominant": {
            "proband_without_called_alternate": no_alt,
            "segregation_incomplete": ~no_alt & (facts["consistent"] < facts["informative"]),
            "segregation_sparse": ~no_alt & (facts["informative"] < 2),
            "segregation_unsupported": ~no_alt
            & ~(facts["carrier_relative"] | (F.col("_m_ref") & F.col("_f_ref"))),
        },
        "homozygous_recessive": {
            "proband_not_homozygous": ~F.col("_p_hom"),
            "parents_incomplete": F.col("_p_hom") & ~parents_called(),
            "parents_not_both_carriers": F.col("_p_hom")
            & parents_called()
            & ~(F.col("_m_het") & F.col("_f_het")),
        },
        "x_linked": {"carrier_mother_not_shown": F.col("x_linked").isin(0.0, 0.2, 0.55, 0.5)},
        "autosomal_recessive": {},
        "compound_heterozygous": {},
    }
    shared = {
        "proband_status_unknown": F.col("proband_affected").isNull(),
        "genotype_quality_failed": ~quality,
    }
    return fields.reasons({**rules[model], **shared})


def single_evidence(trio: DataFrame) -> DataFrame:
    """Long form: one evidence row per variant and single-variant model, no shuffle."""
    fitted = single_fits(trio)
    items = F.array(
        *[
            F.struct(
                F.lit(model).alias("method"),
                F.col(model).alias("score"),
                F.col(
                    "pedigree_quality" if model == "autosomal_dominant" else "trio_quality"
                ).alias("quality_checks_passed"),
                model_warnings(model).alias("warnings"),
            )
            for model in K.SINGLE_MODELS
        ]
    )
    return fitted.select(
        "run_id",
        "variant_id",
        F.upper(F.coalesce("gene", F.lit("UNKNOWN"))).alias("gene"),
        F.col("_p.genotype").alias("proband_genotype"),
        F.col("_m.genotype").alias("mother_genotype"),
        F.col("_f.genotype").alias("father_genotype"),
        "row_id",
        F.explode(items).alias("e"),
    ).select("*", "e.*").drop("e")
