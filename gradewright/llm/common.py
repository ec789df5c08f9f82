"""Helpers the corpus operators share."""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HOT_KEYS = 1000  # a key with over 1/1000 of the rows is hot, so there are at most 1000 of them
TEXT_ROWS = 1000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPACE = b" \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that to pure ASCII, and faster."""
    return (F.when(F.octet_length(text) == F.length(text), F.lower(text))
            .otherwise(F.translate(text, UPPER, UPPER.lower())))


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read it back.

    Once the table is there nobody reads the shuffle files behind it, so they go with the
    write, not when the driver next collects garbage.
    """
    spark = frame.sparkSession
    path = shared_dir(spark, purpose)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(path)


def text_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python in Arrow batches of TEXT_ROWS rows at most, not 10,000."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, TEXT_ROWS)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that hold over 1/HOT_KEYS of all rows: at most HOT_KEYS of them, whatever the input."""
    counts = rows.groupBy(key).count()
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return (counts.join(F.broadcast(total), F.col("count") * HOT_KEYS > F.col("total"))
            .select(key))


def join_by_key(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join rows to facts that have one row per key, with hot keys kept out of the shuffle.

    The facts of hot keys are at most HOT_KEYS rows and are broadcast; all other
    rows take a shuffle join, in which no key is large. ``how``: inner or left.
    """
    hot = written(hot_keys(rows, key), "hot-keys")
    hot_facts = facts.join(F.broadcast(hot), key, "left_semi")
    cold = rows.join(F.broadcast(hot), key, "left_anti").join(facts, key, how)
    # A hot key is in ``rows``; under "left" it stays even if no facts are known.
    warm = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(hot_facts), key, how)
    return cold.unionByName(warm)


def _with_lowest(edges: DataFrame, total: int) -> DataFrame:
    """Edges (u, v) with m, the smallest v of their u.

    A u with over 1/HOT_KEYS of the edges is looked up in a broadcast table (at most
    HOT_KEYS rows); no other u is large in the shuffle join.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
    hot = low.filter(F.col("c") * HOT_KEYS > total).select("u", F.col("m").alias("hot_m"))
    looked_up = edges.join(F.broadcast(hot), "u", "left")
    cold = looked_up.filter("hot_m is null").drop("hot_m").join(low.drop("c"), "u")
    return looked_up.filter("hot_m is not null").withColumnRenamed("hot_m", "m").unionByName(cold)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node each node can reach over undirected edges.

    Alternates large-star and small-star rounds until only stars are left, so long chains
    fold in a logarithmic number of rounds. Minima are map-side aggregates. Every step is
    a written table: a lost executor costs one step. Nodes without any edge to another
    node are their own component.
    """
    links = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                    .filter("u <> v").distinct(), "links")
    total = links.count()
    while total:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every larger neighbour of u moves to the smallest node u knows.
        moved = _with_lowest(both, 2 * total).filter("v > u").select(
            F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = written(moved.distinct(), "links")
        # Small star: u and its smaller neighbours move to the smallest of them.
        joined = _with_lowest(large, large.count())
        links = written(
            joined.select(F.explode(F.array(F.struct(F.col("u"), F.col("m")),
                                            F.struct(F.col("v").alias("u"), F.col("m"))))
                          .alias("e")).select("e.u", F.col("e.m").alias("v"))
            .filter("u <> v").distinct(), "links")
        # Stars only: every leaf has one centre, and no centre is a leaf.
        forks = links.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w")).filter("v <> w").select("u")
        chains = links.select(F.col("v").alias("u")).distinct().join(links, "u", "left_semi").select("u")
        if forks.unionAll(chains).isEmpty():
            break
        total = links.count()
    nodes = edges.select(F.col(a).alias("node")).unionAll(edges.select(F.col(b).alias("node"))).distinct()
    return (nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left")
            .select("node", F.coalesce("m", "node").alias("component")))


def crc_fold(doc_id) -> int:
    """crc32 of the id as text, mod 5; rows of fold 0 are held out of all training."""
    return zlib.crc32(str(doc_id).encode()) % 5


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """Seeded 64-bit finaliser over an array."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def shards_for(spark: SparkSession, items: int, per_shard: int) -> int:
    """Enough shards that none holds over ``per_shard`` items, and a few for every task."""
    return max(2 * partitions(spark), math.ceil(items / per_shard))


def fresh(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex}"
