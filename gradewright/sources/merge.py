"""Reconciling two halves of a dataset and merging regenerated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unmatched(left: DataFrame, right: DataFrame, key: str, left_name: str = "unlabelled",
              right_name: str = "orphaned label") -> DataFrame:
    """Ids present on one side only, as (key, rule, detail)."""
    both = (left.select(key).distinct().withColumn("_l", F.lit(1))
            .join(right.select(key).distinct().withColumn("_r", F.lit(1)), key, "full_outer"))
    rule = F.when(F.col("_r").isNull(), left_name).when(F.col("_l").isNull(), right_name)
    return both.select(F.col(key).cast("string").alias("key"), rule.alias("rule"),
                       F.lit(None).cast("string").alias("detail")).filter(F.col("rule").isNotNull())


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows whose id is on both sides. Check ``unmatched`` first; sort only at the sink."""
    return left.join(right, key)


def latest_by_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key in the given order: a map-side aggregate, no sort of a key's rows.

    Of rows that tie in the order, the one with the largest values stays.
    """
    whole = F.struct(*rows.columns)
    last = rows.groupBy(*keys).agg(F.max_by(whole, F.struct(*order, whole)).alias("_last"))
    return last.select("_last.*")


def merge_by_key(existing: DataFrame, regenerated: DataFrame, keys: Sequence[str],
                 order: Sequence[str] = ()) -> DataFrame:
    """Regenerated rows replace existing ones with the same key; the rest stay.

    With ``order``, columns of the regenerated rows only, the last writer of a key wins;
    without it their keys must be unique.
    """
    if order:
        regenerated = latest_by_key(regenerated, keys, order).drop(*order)
    kept = existing.join(regenerated.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(regenerated)


def upsert_provenance(existing: DataFrame, regenerated: DataFrame, generator: str,
                      keys: Sequence[str]) -> DataFrame:
    """Per-record provenance with the regenerated records pointing at their new generator.

    Kept as rows. Run totals belong to the run and are written anew each time.
    """
    stamped = regenerated.select(*keys, F.lit(generator).alias("generator_model"))
    return merge_by_key(existing, stamped, keys)
