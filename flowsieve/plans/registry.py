"""All registered queries of the core and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowsieve.plans import analysis_queries, clean_queries, data_queries, evaluation_queries, metric_queries, source_queries, window_queries

MODULES = [data_queries, source_queries, clean_queries, metric_queries, window_queries, analysis_queries, evaluation_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return metric_queries.QUERIES["agg12_system_metrics"](spark, folder)
