"""Registry of runnable queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import views


class Tables:
    """Reads base tables and input views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def sql(self, statement: str) -> DataFrame:
        text = views.compose(statement, "spark")
        for name in views.base_tables(text):
            self.base(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    oracle: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None):
    """Register ``build(tables) -> DataFrame`` under a name, with its DuckDB twin."""
    def keep(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(build, oracle)
        return build
    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, _q=q: _q.build(Tables(spark, folder)))
            for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: views.compose(q.oracle, "duckdb")
            for name, q in QUERIES.items() if q.oracle is not None}
