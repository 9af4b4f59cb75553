"""All queries over the reference's operators, by key, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``key``, with its SQL where SQL can express it."""

    def put(f: Query) -> Query:
        _queries[key] = f
        if sql:
            _sql[key] = sql
        return f

    return put


def registry_sql(key: str) -> str:
    """The SQL of a query that is registered already."""
    return _sql[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    from voxelake.plans import geometry, images, lines, masks, records, views, volumes  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
