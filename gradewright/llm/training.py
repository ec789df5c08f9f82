"""Bounded labelled samples for the classifiers trained here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of the training folds; ids whose labels disagree are left out."""
    return (labels.select("doc_id", F.col(column).cast("int").alias("label"))
            .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id")) != 0))
            .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("high"))
            .filter("label = high").drop("high"))


def by_hash(rows: DataFrame, key: str, count: int) -> DataFrame:
    """``count`` rows in the order of a hash of the key: a fixed sample, whatever the layout."""
    return rows.orderBy(F.xxhash64(key), key).limit(count)


def labelled_sample(labels: DataFrame, column: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` ids of each class, and the size of each class."""
    rows = labelled(labels, column)
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    parts = [by_hash(rows.filter(F.col("label") == c), "doc_id", per_class) for c in (0, 1)]
    return parts[0].unionByName(parts[1]), sizes


def sample_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The documents of a bounded sample of ids; their number is bounded, so it is broadcast."""
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
