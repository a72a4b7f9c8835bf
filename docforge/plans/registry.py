"""Queries of the library's own operators, by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracles() -> dict[str, str]:
    _load()
    return _ORACLES


def _load() -> None:
    from docforge.plans import document_queries, evaluation_queries, language_queries, metadata_queries, retrieval_queries, summary_queries, text_queries  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best documents for each benchmark passage."""
    return queries()["bm25_topk"](spark, sf_dir)
