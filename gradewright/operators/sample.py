"""Deterministic samples, numbering and blind packets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.fingerprint import table_fingerprints


def dense_positions(rows: DataFrame, key: str, levels: Sequence[int], out: str = "position"
                    ) -> DataFrame:
    """1-based position of every row in the order of a unique text key.

    A plain row_number over the whole table sorts everything in one task. Here
    rows are counted per key prefix, level by level: each window runs over the
    buckets of one parent prefix, and rows are numbered inside their deepest
    bucket only. ``levels`` are prefix lengths, shortest first; choose the
    deepest so that a bucket fits a task.
    """
    names = [f"_p{n}" for n in levels]
    cut = rows.withColumns({n: F.substring(key, 1, k) for n, k in zip(names, levels)})
    counts = cut.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    offsets = None
    for depth, name in enumerate(names):
        parents = names[:depth]
        level = counts.groupBy(*parents, name).agg(F.sum("_n").alias("_n"))
        order = Window.partitionBy(*parents).orderBy(name).rowsBetween(
            Window.unboundedPreceding, -1)
        level = level.select(*parents, name,
                             F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
        if offsets is None:
            offsets = level
        else:
            offsets = level.join(offsets.withColumnRenamed("_before", "_above"), parents).select(
                *parents, name, (F.col("_before") + F.col("_above")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*names).orderBy(key))
    return (cut.join(offsets, names).withColumn(out, F.col("_before") + inside)
            .drop(*names, "_before"))


def padded_id(prefix: str, number: Column, width: int = 9) -> Column:
    """Prefix and number, padded with zeros; a longer number keeps all its digits."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0")))


def first_records(rows: DataFrame, n: int, order: Sequence[str] = ("record_id",)) -> DataFrame:
    """First n rows in id order: a top-k per partition, never a full sort."""
    return rows.orderBy(*order).limit(n)


def stratified_sample(records: DataFrame, size: int, stratum: str = "expected_type",
                      key: str = "record_id", exclude: str = "REFUSAL") -> DataFrame:
    """Round-robin over classes in class order, ids in order inside a class.

    A class can contribute at most ``size`` rows; that rank filter becomes a
    group limit below the shuffle, so the sample costs no class-sized sort.
    """
    eligible = records.filter(~F.array_contains("tags", exclude))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(key))
    ranked = eligible.withColumn("_turn", rank).filter(F.col("_turn") <= size)
    return ranked.orderBy("_turn", stratum).limit(size).drop("_turn")


def blind_packet(variants: DataFrame, key: str, shown: Sequence[str], hidden: Sequence[str],
                 seed: str, prefix: str, levels: Sequence[int] = (3,)
                 ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packet, private key and key header of a blind review.

    Order comes from a seeded hash of the variant key and is reproducible. The
    packet holds no label column; the header ties the key to its source table.
    """
    leaked = set(shown) & set(hidden)
    if leaked:
        raise ValueError(f"columns both shown and hidden: {sorted(leaked)}")
    shuffled = variants.withColumn("_h", F.sha2(F.concat(
        F.lit(seed + ":"), F.col(key).cast("string")), 256))
    numbered = dense_positions(shuffled, "_h", levels)
    named = numbered.withColumn("blind_id", padded_id(prefix + "-", F.col("position")))
    header = table_fingerprints(variants, [], [key, *shown, *hidden]).withColumn(
        "seed", F.lit(seed))
    return named.select("blind_id", *shown), named.select("blind_id", key, *hidden), header

