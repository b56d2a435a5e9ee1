"""Every query of the transcript engine by name, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name; sql is its twin."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


from lectern.plans import queries_model, queries_review, queries_text, queries_windows  # noqa: E402, F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, windows, fold, running groups, ordered aggregation, equi and range joins in one: chapters and what is wrong with them."""
    return queries_review.flagship_chapters(spark, sf_dir)
