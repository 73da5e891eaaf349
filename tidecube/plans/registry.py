"""All queries of the library and the DuckDB SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidecube.plans import cleaning_queries, cube_queries, forecast_queries, io_queries, more_queries, publish_queries, serving_queries, step_queries, table_queries

Query = Callable[[SparkSession, str], DataFrame]
PARTS = [cube_queries, cleaning_queries, forecast_queries, serving_queries, io_queries, more_queries, step_queries, publish_queries, table_queries]


def queries() -> dict[str, Query]:
    return {name: fn for part in PARTS for name, (fn, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, (_, sql) in part.QUERIES.items() if sql}
