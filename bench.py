"""Headline queries, timed one by one; prints one JSON line.

Every query is run to completion into the no-op sink. ``prepare_*`` entries
write the stand-in inputs (variants, record text, ontology closure) that the
other queries scan.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from varloom.operators import annotate as A  # noqa: E402
from varloom.operators import pairs as P  # noqa: E402
from varloom.operators import ranking as R  # noqa: E402
from varloom.plans import branch_plan as BP  # noqa: E402
from varloom.plans import case_analysis as CA  # noqa: E402
from varloom.session import build_session  # noqa: E402
from varloom.sources import vcf as V  # noqa: E402
from workload import catalog  # noqa: E402
from workload import queries_relational as QR  # noqa: E402
from workload import shared as S  # noqa: E402
from workload import tables as T  # noqa: E402
from workload import text as X  # noqa: E402

CPUS = int(os.environ.get("BENCH_CPUS", "8"))
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def analysis(spark, sf):
    """Evidence, branches and the full rank of all candidates in the four default modes."""
    features = CA.feature_rows(T.variants(spark, sf), S.pedigree(spark, sf), S.gene_scores(spark, sf))
    planned = BP.run_plan(features)["features"]
    scored = R.context_scores(planned, R.contexts()[:4])
    return R.rank_candidates(scored.select("run_id", "context", "variant_id", "score"))


def all_contexts(spark, sf):
    """Full rank in all 28 contexts over saved features."""
    planned = BP.run_plan(QR.features(spark, sf), saved=True)["features"]
    scored = R.context_scores(planned)
    return R.rank_candidates(scored.select("run_id", "context", "variant_id", "score"))


def annotation(spark, sf):
    records = A.annotated_records(X.annotated_fields(spark, sf).select("f"))
    return A.import_annotation(records, X.CSQ_LAYOUT)["variants"]


QUERIES = {
    "prepare_variants": lambda s, sf: T.variants(s, sf),
    "prepare_ontology": lambda s, sf: S.ancestors(s, sf),
    "prepare_text": lambda s, sf: X.record_lines(s, sf).unionByName(X.record_lines(s, sf)),
    "flagship_top20": catalog.flagship,
    "evidence_and_rank": analysis,
    "evidence_rows": lambda s, sf: CA.long_evidence(T.variants(s, sf), S.pedigree(s, sf), S.gene_scores(s, sf)),
    "pair_list": lambda s, sf: P.pair_phase(S.trio(s, sf)),
    "pair_best": lambda s, sf: P.inheritance_table(S.trio(s, sf)).select("run_id", "variant_id", "compound"),
    "prepare_features": lambda s, sf: QR.features(s, sf),
    "rank_28_contexts": all_contexts,
    "gene_scores": lambda s, sf: S.gene_scores(s, sf),
    "vcf_scan": lambda s, sf: V.split_alleles(X.vcf_lines(s, sf)),
    "annotation_import": annotation,
    "rarity_filter": catalog.QUERIES["d02_rarity_filter"],
    "branch_statistics": catalog.QUERIES["g01_branch_statistics"],
    "evidence_reduce": catalog.QUERIES["g06_evidence_reduce"],
    "segmentation": catalog.QUERIES["h06_segmentation"],
    "retrieval_metrics": catalog.QUERIES["g12_retrieval_metrics"],
    "sensitive_scan": catalog.QUERIES["c26_sensitive_content_scan"],
}


def main() -> None:
    spark = build_session(f"local[{CPUS}]", CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).agg(F.sum("id")).collect()
    only = sys.argv[1:]
    times = {}
    for name, build in QUERIES.items():
        if only and name not in only:
            continue
        start = time.perf_counter()
        build(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
