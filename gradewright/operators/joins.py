"""Joins in which one key may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000   # a key with over 1/HOT_SHARE of all rows is hot, so there are fewer than that
SALTS = 64         # parts a hot key's rows are dealt to


def hot_values(rows: DataFrame, key: str, share: int | None = None) -> list:
    """The hot keys: fewer than ``share`` values, whatever the input. Counted map-side.

    Of fewer than ``share`` rows none is hot: no task can get many.
    """
    share = share or HOT_SHARE
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).count()
    total = rows.count()
    if total < share:
        return []
    return [r[key] for r in counts.filter(F.col("count") * share > total).select(key).collect()]


def split_join(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner",
               unique: bool = True, share: int | None = None) -> DataFrame:
    """Join rows to facts on a key that may be skewed on the side of the rows.

    ``unique``: the facts have one row per key. Then the facts of hot keys, fewer than
    ``share`` rows, are broadcast and only the other rows are shuffled. Otherwise a hot
    key's rows are dealt to SALTS parts, its facts copied to each. ``how``: inner or left.
    Without a hot key this is a plain join.
    """
    hot = hot_values(rows, key, share)
    if not hot:
        return rows.join(facts, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    if unique:
        return rows.filter(~is_hot).join(facts, key, how).unionByName(
            rows.filter(is_hot).join(F.broadcast(facts.filter(is_hot)), key, how))
    salt = F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = facts.withColumn("_salt", F.explode(copies))
    return rows.withColumn("_salt", salt).join(dealt, [key, "_salt"], how).drop("_salt")


def constant(value: str, schema: str) -> Column:
    """A nested constant from JSON, folded once into the plan; for lookups of a checked size."""
    return F.from_json(F.lit(value), schema)


def in_chunks(rows: DataFrame, keys: Sequence[str], item: str, most: int, out: str) -> DataFrame:
    """Items of each key as arrays of about ``most``, so that no group becomes one long row."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    chunk = F.pmod(F.xxhash64(item), F.ceil(F.col("_n") / most))
    return (rows.join(sizes, list(keys)).withColumn("_chunk", chunk).groupBy(*keys, "_chunk")
            .agg(F.collect_set(item).alias(out)))
