"""Queries and their SQL by name. Modules of corpusmill.plans register theirs on import."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
PLANS = "cleaning dedup contamination mixture sharding tokens analytics ledgers numeric relational streams models".split()
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query with the DuckDB SQL that gives the same rows, where SQL can express them."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"{key} is registered twice")
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


def _load() -> None:
    for plan in PLANS:
        import_module(f"corpusmill.plans.{plan}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, exact-deduplicate and decontaminate the documents: what is left of them."""
    from .operators import clean, contamination, dedup
    from .session import table

    docs = table(spark, sf_dir, "documents")
    good = docs.where(clean.drop_reason().isNull())
    first = dedup.exact(good, ["doc_id"]).where("duplicate_of IS NULL").drop("duplicate_of")
    bad = contamination.contaminated(first, table(spark, sf_dir, "benchmark"))
    return first.join(bad, "doc_id", "left_anti").select("doc_id", "lang", "source", "n_chars", "text")
