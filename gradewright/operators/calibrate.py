"""Calibration of stated confidence against observed accuracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.banding import required_n, wilson


def bucket_low(confidence: Column, edges: Sequence[float] = fixed.CALIBRATION_EDGES) -> Column:
    """Lower edge of the bucket; 0.0 is the underflow bucket and takes everything else."""
    ladder = None
    for low, high in zip(edges, edges[1:]):
        inside = (confidence >= low) & (confidence < high)
        ladder = F.when(inside, low) if ladder is None else ladder.when(inside, low)
    return ladder.otherwise(0.0)


def calibration_table(pairs: DataFrame, keys: Sequence[str] = (),
                      edges: Sequence[float] = fixed.CALIBRATION_EDGES) -> DataFrame:
    """One row per populated bucket: n, hits, accuracy, mean confidence.

    ``pairs`` has ``confidence`` and boolean ``correct``. The squared error sum
    rides along so ECE and Brier need no second pass over the records.
    """
    hit = F.when(F.col("correct"), 1.0).otherwise(0.0)
    upper = {low: high for low, high in zip(edges, edges[1:])} | {0.0: edges[0]}
    high_of = F.create_map(*[F.lit(x) for kv in upper.items() for x in kv])
    return (pairs.groupBy(*keys, bucket_low(F.col("confidence"), edges).alias("low"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(hit).cast("bigint").alias("hits"),
                 F.avg(hit).alias("accuracy"), F.avg("confidence").alias("mean_confidence"),
                 F.sum(F.pow(F.col("confidence") - hit, 2)).alias("squared_error"))
            .withColumn("high", F.try_element_at(high_of, F.col("low"))))


def calibration_intervals(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Wilson interval per bucket, its width, and the n a ±0.05 claim would need.

    ``required_n`` is taken at the overall accuracy of the key, ``bucket_required_n`` at
    that of the bucket. The table has one row per bucket, so its window is tiny.
    """
    low, high = wilson(F.col("hits"), F.col("n"))
    whole = Window.partitionBy(*keys)
    overall = F.try_divide(F.sum("hits").over(whole).cast("double"), F.sum("n").over(whole))
    return (table.withColumn("interval_low", low).withColumn("interval_high", high)
            .withColumn("width", F.col("interval_high") - F.col("interval_low"))
            .withColumn("bucket_required_n", required_n(F.col("accuracy")))
            .withColumn("required_n", required_n(overall)))


def widest_bucket(intervals: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The least certain bucket per key (lowest bucket on equal width)."""
    return intervals.groupBy(*keys).agg(
        F.max_by(F.struct("low", "n", "width"),
                 F.struct(F.col("width"), -F.col("low"))).alias("w")
    ).select(*keys, "w.low", "w.n", "w.width")


def calibration_error(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error and Brier score from the bucket table."""
    gap = F.abs(F.col("accuracy") - F.col("mean_confidence"))
    total = F.sum("n")
    return table.groupBy(*keys).agg(
        total.alias("n"),
        F.try_divide(F.sum(F.col("n") * gap), total).alias("ece"),
        F.try_divide(F.sum("squared_error"), total).alias("brier"))


def least_confident(rows: DataFrame, keys: Sequence[str], k: int,
                    order: Sequence[str] = ("confidence", "record_id")) -> DataFrame:
    """The k lowest-confidence rows per key.

    The rank filter is pushed below the shuffle as a per-partition group limit,
    so a hot key sends at most k rows per partition.
    """
    ranked = rows.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)
