"""Steps of streams that fold into tables kept in versions: queue state and running cell sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.gate import add_running_sums
from ..operators.review import apply_decisions, first_decisions


def queue_step(order: Sequence[str] = ("ts",)):
    """Fold a batch of decisions into the queue; decided items are never offered again."""
    def step(queue: DataFrame, batch: DataFrame) -> DataFrame:
        return apply_decisions(queue, first_decisions(batch, queue, order))
    return step


def empty_sums(spark, keys: Sequence[str]) -> DataFrame:
    """Version 0 of a running-sum table."""
    return spark.createDataFrame([], ", ".join(f"{k} STRING" for k in keys) + ", n BIGINT, total DOUBLE")


def sums_step(keys: Sequence[str], value: str = "score"):
    """Fold a batch of scores into mergeable (n, total) sums per key."""
    def step(state: DataFrame, batch: DataFrame) -> DataFrame:
        partial = batch.groupBy(*keys).agg(F.count(value).alias("n"),
                                           F.sum(value).cast("double").alias("total"))
        return add_running_sums(state, partial, keys)
    return step


def count_step(keys: Sequence[str], name: str = "n"):
    """Fold a batch of rows into row counts per key."""
    def step(state: DataFrame, batch: DataFrame) -> DataFrame:
        counts = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
        return state.unionByName(counts).groupBy(*keys).agg(F.sum(name).alias(name))
    return step


def finished_cells(sums: DataFrame, expected: int, cell: str, metrics: int) -> DataFrame:
    """Cells whose every metric has at least the expected number of scores."""
    per_cell = sums.groupBy(cell).agg(F.count_if(F.col("n") >= expected).alias("_done"))
    return per_cell.filter(F.col("_done") >= metrics).select(cell)
