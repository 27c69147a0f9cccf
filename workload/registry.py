"""Collects the queries and their SQL checks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from varloom.session import ensure_checkpoint_dir
from workload.tables import duckdb_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the equivalent statement for the check engine."""

    def add(function):
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def with_tables(*names: str, extra: str = "", body: str, recursive: bool = False) -> str:
    """``WITH`` statement over derived tables, further CTEs and a body."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    parts = [duckdb_with(*names)] if names else []
    if extra:
        parts.append(extra.strip().rstrip(","))
    return head + ",\n".join(parts) + "\n" + body


def scratch(spark: SparkSession, name: str) -> str:
    """Fresh folder below the shared checkpoint folder, for queries that write and read back."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
