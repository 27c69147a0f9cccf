"""All registered queries and the flagship query."""

from __future__ import annotations

from workload import queries_columns, queries_domain, queries_relational, queries_sources  # noqa: F401
from workload.queries_domain import flagship
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]

# integer sums are wider in the check engine; give them the type Spark returns
_BIGINT_COLUMNS = {
    "b01_variant_parquet_sink": ["positions"],
    "c03_multi_allelic_split": ["n_alt", "positions", "alternate_length"],
    "d07_genomic_preflight": ["missing_genotypes", "missing_annotations"],
    "e08_branch_summaries": ["n"],
    "e12_survival_by_branch": ["held"],
    "f14_shard_selection": [
        "included_records", "included_alleles", "unprocessed_records", "unprocessed_alleles",
    ],
    "g11_source_accounting": ["alternate_alleles"],
    "g14_evaluation_rollup": ["false_positive_models"],
    "g18_import_metrics": ["value"],
    "h06_segmentation": ["alternate_alleles"],
    "j01_multiset_difference": ["surplus"],
    "j02_genotype_reconciliation": ["surplus"],
}
for _name, _columns in _BIGINT_COLUMNS.items():
    _casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _columns)
    ORACLES[_name] = f"SELECT * REPLACE ({_casts}) FROM (\n{ORACLES[_name]}\n) AS result"
