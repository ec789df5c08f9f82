"""Content fingerprints and drift against a manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_fingerprints(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SHA-256 per file of a small-file folder, hashed on the executors."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", "true").load(path))
    return files.select(F.col("path").alias("name"), F.sha2("content", 256).alias("fingerprint"))


def folder_fingerprints(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Content fingerprint per folder under ``path``: its number of files and sums of their digests.

    ``name`` is the folder below ``path`` ("" for ``path`` itself), so two deliveries of the
    same data compare alike, whatever the names and order of their files.
    """
    files = file_fingerprints(spark, path, pattern)
    base = path.rstrip("/") + "/"
    below = F.expr("substring(name, locate({0}, name) + length({0}))".format("'" + base.replace("'", "\\'") + "'"))
    folder = F.regexp_replace(below, "/?[^/]*$", "")
    return _summed(files.select(folder.alias("name"), F.col("fingerprint").alias("_h")), ["name"])


def _summed(hashed: DataFrame, group: Sequence[str]) -> DataFrame:
    """Row count and two sums of 60 bits of the hex digest ``_h`` per group."""
    sums = [F.sum(F.conv(F.substring("_h", start, 15), 16, 10).cast("decimal(38,0)")).cast("decimal(38,0)")
            .cast("string") for start in (1, 16)]
    return hashed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.concat_ws("-", *sums).alias("fingerprint"))


def table_fingerprints(rows: DataFrame, group: Sequence[str],
                       columns: Sequence[str]) -> DataFrame:
    """Order-free content fingerprint per group: row count and a sum of row hashes.

    Two independent sums of 60 bits each of the SHA-256 over the delimited columns. A sum does not depend on row order or partitioning and combines map-side,
    so one huge group costs no more than many small ones.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
                                 for c in columns])
    return _summed(rows.select(*group, F.sha2(text, 256).alias("_h")), group)


def drift(current: DataFrame, manifest: DataFrame, keys: Sequence[str],
          fingerprint: str = "fingerprint") -> DataFrame:
    """Each key as unchanged / changed / added / removed against the manifest."""
    now = current.select(*keys, F.col(fingerprint).alias("_now"))
    then = manifest.select(*keys, F.col(fingerprint).alias("_then"))
    status = (F.when(F.col("_then").isNull(), "added").when(F.col("_now").isNull(), "removed")
              .when(F.col("_now") == F.col("_then"), "unchanged").otherwise("changed"))
    return now.join(then, list(keys), "full_outer").select(*keys, status.alias("status"))
