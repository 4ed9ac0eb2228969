"""The registered queries and their SQL, collected from the operator modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexweave.plans import audit_queries, corpus_queries, diversity_queries, export_queries, network_queries, profile_queries, records_queries, source_queries

_MODULES = (records_queries, diversity_queries, profile_queries, corpus_queries, network_queries, audit_queries, export_queries, source_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in _MODULES:
        out.update(m.queries())
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in _MODULES:
        out.update(m.oracle_sql())
    return out
