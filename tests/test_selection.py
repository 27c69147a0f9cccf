import random

from pyspark.sql import functions as F

from varloom.operators import selection as SEL

FIXED = ("homozygous_alt", "haploid_alt")


def coord(c):
    chrom = c["chromosome"]
    chrom = chrom[3:] if chrom.lower().startswith("chr") else chrom
    return (chrom.upper(), c["position"], c["reference"].upper(), c["alternate"].upper())


def brute_force(candidates, pairs, ranked, limit):
    """Plain scan over every pair of every anchor."""
    by_id = {c["allele_id"]: c for c in candidates}
    anchors = sorted((c for c in candidates if c["allele_id"] in ranked), key=lambda c: (c["rank"], c["allele_id"]))[:100]
    taken, chosen, audit = set(), [], {}

    def note(anchor, reason):
        audit[(anchor, reason)] = audit.get((anchor, reason), 0) + 1

    for a in anchors:
        if len(chosen) == limit:
            break
        me = a["allele_id"]
        if coord(a) in taken:
            note(me, "skipped_consumed_endpoint")
            continue
        if a["state"] in ("reference", "unknown"):
            note(me, f"unavailable_{a['state']}_genotype")
            continue
        reason, partner = None, None
        if a["state"] in FIXED:
            reason = {"homozygous_alt": "homozygous_alternate_call", "haploid_alt": "haploid_alternate_call"}[a["state"]]
        elif a["de_novo_supported"]:
            reason = "saved_de_novo_with_reference_parents_and_quality"
        else:
            mine = [p for p in pairs if me in (p["source_a"], p["source_b"])]
            best = {}
            for p in mine:
                other = p["source_b"] if p["source_a"] == me else p["source_a"]
                key = (-p["confidence"], p["variant_a"], p["variant_b"])
                if other not in best or key < best[other][0]:
                    best[other] = (key, p)
            ordered = sorted(
                best.items(),
                key=lambda kv: (-kv[1][1]["confidence"], by_id[kv[0]]["rank"], *sorted((me, kv[0])), kv[1][1]["variant_a"], kv[1][1]["variant_b"]),
            )
            for other, (_, p) in ordered:
                o = by_id[other]
                if other == me:
                    bad = "same_source_allele"
                elif coord(o) == coord(a):
                    bad = "same_coordinates"
                elif coord(o) in taken:
                    bad = "consumed_endpoint"
                elif coord(o)[0] != coord(a)[0]:
                    bad = "different_chromosomes"
                elif p["gene"] not in a["genes"] or p["gene"] not in o["genes"]:
                    bad = "gene_mismatch"
                elif a["state"] != "heterozygous" or o["state"] != "heterozygous":
                    bad = "nonheterozygous_call"
                elif p["contradiction"]:
                    bad = "observed_contradiction"
                elif p["phase"] not in ("confirmed_trans", "possible_trans", "unknown"):
                    bad = "unsupported_phase"
                else:
                    partner, reason = other, "saved_compound_heterozygous_hypothesis"
                    break
                note(me, f"rejected_pair_{bad}")
            reason = reason or "exploratory_singleton_no_eligible_saved_pair"
        note(me, reason)
        chosen.append((len(chosen) + 1, me, partner, reason))
        taken.add(coord(a))
        if partner:
            taken.add(coord(by_id[partner]))
    return chosen, audit


def random_case(seed, n):
    rng = random.Random(seed)
    candidates, mapping = [], []
    for i in range(n):
        candidates.append(
            {
                "allele_id": f"a{i:03d}", "chromosome": rng.choice(["1", "chr1", "2"]), "position": rng.randint(1, 40),
                "reference": "A", "alternate": rng.choice(["C", "c", "G"]), "genes": sorted(rng.sample(["G1", "G2", "G3"], 2)),
                "state": rng.choices(["heterozygous", "homozygous_alt", "reference", "unknown", "haploid_alt"], [12, 1, 1, 1, 1])[0],
                "de_novo_supported": rng.random() < 0.05, "rank": i + 1,
            }
        )
        for j in range(2):
            mapping.append((f"v{i:03d}{j}", f"a{i:03d}"))
    source = dict(mapping)
    pairs = []
    for _ in range(n * 12):
        x, y = sorted(rng.sample(range(len(mapping)), 2))
        va, vb = mapping[x][0], mapping[y][0]
        if any(p["variant_a"] == va and p["variant_b"] == vb for p in pairs):
            continue
        pairs.append(
            {
                "variant_a": va, "variant_b": vb, "source_a": source[va], "source_b": source[vb], "gene": rng.choice(["G1", "G2", "G3"]),
                "phase": rng.choice(["confirmed_trans", "unknown", "odd"]), "confidence": rng.choice([0.25, 0.55, 0.95]),
                "contradiction": rng.random() < 0.1,
            }
        )
    ranked = {c["allele_id"] for c in candidates if rng.random() < 0.8}
    for c in candidates:
        if c["allele_id"] not in ranked:
            c["rank"] = len(ranked) + 1
    return candidates, mapping, pairs, ranked


def test_selection_equals_brute_force(spark):
    cases = {f"run{s}": random_case(s, n) for s, n in ((1, 30), (2, 60), (3, 130))}
    schema = ("run_id string, allele_id string, chromosome string, position bigint, reference string, alternate string, "
              "genes array<string>, state string, de_novo_supported boolean, rank bigint")
    names = [f.split()[0] for f in schema.split(", ")[1:]]
    cand = spark.createDataFrame([(r, *[c[k] for k in names]) for r, (cs, _, _, _) in cases.items() for c in cs], schema)
    maps = spark.createDataFrame([(r, v, a) for r, (_, m, _, _) in cases.items() for v, a in m], "run_id string, variant_id string, allele_id string")
    keys = ["variant_a", "variant_b", "gene", "phase", "confidence", "contradiction"]
    prs = spark.createDataFrame(
        [(r, *[p[k] for k in keys]) for r, (_, _, ps, _) in cases.items() for p in ps],
        "run_id string, variant_a string, variant_b string, gene string, phase string, confidence double, contradiction boolean",
    )
    ranks = cand.join(
        spark.createDataFrame([(r, a) for r, (_, _, _, rk) in cases.items() for a in rk], "run_id string, allele_id string"),
        ["run_id", "allele_id"],
    ).select("run_id", "allele_id", F.col("rank").alias("base_rank"))
    anchor_rows = SEL.anchors(ranks)
    out = SEL.select_hypotheses(anchor_rows, SEL.incident_pairs(anchor_rows, prs, maps), cand)
    for run, (cs, _, ps, ranked) in cases.items():
        want, audit = brute_force(cs, ps, ranked, 10)
        rows = out["hypotheses"].where(F.col("run_id") == run).orderBy("submission_rank").collect()
        assert [(r.submission_rank, r.first, r.second, r.reason) for r in rows] == want
        got = {(r.anchor, r.reason): r["count"] for r in out["audit"].where(F.col("run_id") == run).collect()}
        assert got == audit
    assert any(h[2] for run in cases for h in brute_force(*[cases[run][i] for i in (0, 2, 3)], 10)[0])


def test_rank_mass_text(spark):
    rows = spark.range(1, 11).select("id", SEL.epcr_text(F.col("id")).alias("t"), SEL.epcr(F.col("id")).alias("d"), SEL.residual(F.col("id")).alias("r"))
    got = {r.id: (r.t, r.r) for r in rows.collect()}
    assert got[1] == ("0.1000", "0.9000") and got[2] == ("0.080000", "0.820000")
    assert got[10][0] == "0.0134217728000000000000"
    assert all(f"{r.d.normalize()}" == f"{r.d.__class__(r.t).normalize()}" for r in rows.collect())


HEAD = "run_id string, row_no int, submission_rank int, proband_id string, chrom_1 string, pos_1 string, ref_1 string, alt_1 string, chrom_2 string, pos_2 string, ref_2 string, alt_2 string, epcr string, finding_type string, notes string"


def row(n, **edit):
    base = dict(run_id="r", row_no=n, submission_rank=n, proband_id="P", chrom_1="1", pos_1=str(n), ref_1="A", alt_1="C", chrom_2="", pos_2="",
                ref_2="", alt_2="", epcr=f"{0.5 / n:.6f}", finding_type="primary", notes="x")
    return tuple({**base, **edit}.values())


def reasons(spark, rows):
    return {r.reason for r in SEL.validate_submission(spark.createDataFrame(rows, HEAD)).collect()}


def test_submission_contract(spark):
    assert reasons(spark, [row(1), row(2)]) == set()
    assert reasons(spark, [row(n) for n in range(1, 12)]) == {"row_count"}
    assert reasons(spark, [row(1), row(2, epcr="0.9")]) == {"epcr_increases"}
    assert reasons(spark, [row(1, epcr="nan")]) == {"invalid_epcr"}
    swapped = dict(chrom_2="1", pos_2="9", ref_2="A", alt_2="C")
    assert reasons(spark, [row(1, **swapped), row(9, chrom_2="1", pos_2="01", ref_2="a", alt_2="c", epcr="0.01")]) == {"duplicate_candidate"}
    assert reasons(spark, [row(1, chrom_2="1")]) == {"incomplete_second_endpoint"}
    assert reasons(spark, [row(1, chrom_2="1", pos_2="1", ref_2="A", alt_2="C")]) == {"same_endpoints"}
    assert reasons(spark, [row(1), row(2, proband_id="Q")]) == {"several_probands"}
