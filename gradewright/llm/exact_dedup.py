"""Exact deduplication against a persistent digest index.

The index is a folder of parquet tables, one a batch, each bucketed and sorted by digest
with one file per bucket. A new batch is reduced to one row per text, shuffled and
sorted once, and goes through a sort-merge anti-join with each table; the tables are
read in their stored order, without a shuffle or a sort. What is left is appended as a
table of its own. Several tables are merged into one when there are over MOST_TABLES.
Whole texts never leave the scan: only 32-byte digests and ids are shuffled,
pre-aggregated map-side.
"""

from __future__ import annotations

import json
import re
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, join_by_key, partitions, written

MOST_TABLES = 8
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
_ROW = "digest binary, keep_id long, copies long, batch string"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


class DigestIndex:
    """Rows (digest, keep_id, copies, batch) of every text seen so far.

    ``path`` is a folder all executors share. Opening the same path again, in this
    or a later session, continues the index; ``buckets`` must then be the same. One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = buckets or partitions(spark)

    # -- folders: "batch-<id>", and "merged-<uuid>" with a file that lists what it replaces ---
    def _at(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def _files(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        files = self._files()
        return ([s.getPath().getName() for s in files.listStatus(self._at())] if files.exists(self._at()) else [])

    def _cover(self, name: str, covered: list[str]) -> None:
        """Publish a merged folder: from here on it is read and what it covers is not."""
        out = self._files().create(self._at(f"{name}.covers"), True)
        out.write(bytearray(json.dumps(covered).encode()))
        out.close()

    def _covered(self, names: list[str]) -> dict[str, list[str]]:
        return {n.removesuffix(".covers"): json.loads(self.spark.read.text(self._at(n).toString()).first()[0])
                for n in names if n.endswith(".covers")}

    def folders(self) -> list[str]:
        """Complete folders that no merged one replaces."""
        names, files = self._names(), self._files()
        covers = self._covered(names)
        gone = {old for replaced in covers.values() for old in replaced}
        return sorted(n for n in names if n not in gone and (n.startswith("batch-") or n in covers)
                      and files.exists(self._at(n, "_SUCCESS")))

    def _settle(self) -> None:
        """Finish a merge: remove what it replaced, so that those names are free again."""
        for name, replaced in self._covered(self._names()).items():
            if replaced:
                for old in replaced:
                    self._files().delete(self._at(old), True)
                    self._files().delete(self._at(f"{old}.covers"), False)
                self._cover(name, [])

    @contextmanager
    def _tables(self, names: list[str]):
        """The folders as bucketed tables, read in their stored order; catalogue entries go afterwards."""
        made, before = [], self.spark.conf.get(_ORDERED, None)
        self.spark.conf.set(_ORDERED, "true")
        try:
            for name in names:
                made.append(fresh("digest_index"))
                self.spark.sql(f"""CREATE TABLE {made[-1]} (digest BINARY, keep_id BIGINT, copies BIGINT, batch STRING)
                    USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS
                    LOCATION '{self._at(name).toString()}'""")
            yield [self.spark.table(t) for t in made]
        finally:
            for table in made:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")  # external: the files stay
            if before is None:
                self.spark.conf.unset(_ORDERED)
            else:
                self.spark.conf.set(_ORDERED, before)

    def _store(self, rows: DataFrame, name: str) -> None:
        """One sorted file per bucket; a folder that a lost run left is replaced."""
        table = fresh("digest_index")
        self._files().delete(self._at(name), True)
        (rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.format("parquet")
         .bucketBy(self.buckets, "digest").sortBy("digest").option("path", self._at(name).toString())
         .saveAsTable(table))
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def rows(self) -> DataFrame:
        paths = [self._at(n).toString() for n in self.folders()]
        return self.spark.read.schema(_ROW).parquet(*paths) if paths else self.spark.createDataFrame([], _ROW)

    def merge(self) -> None:
        """Rewrite all tables as one. Until the merged one is complete, the old ones are read."""
        names, name = self.folders(), "merged-" + fresh("t")
        self._store(self.rows(), name)
        self._cover(name, names)
        self._settle()

    def unseen(self, seen: DataFrame, tables: list[DataFrame], batch: str) -> DataFrame:
        """Rows of ``seen``, bucketed and sorted like the tables, whose digest no other batch has registered."""
        for table in tables:
            others = table.filter(F.col("batch") != batch).select("digest")
            seen = seen.join(others.hint("merge"), "digest", "left_anti")
        return seen

    def add(self, docs: DataFrame, batch: str, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Register a batch; return one decision row per input row.

        Columns: the key, keep_id (key of the row that stays), group_size (rows with
        this text in the batch, plus those counted when it was first registered, if
        that was an earlier batch), kept, digest. In a batch the largest key stays; a
        text registered by another batch stays as it was, and the whole batch group goes.

        ``batch`` names the batch (letters, digits, ``_``, ``-``). The same batch added
        again, whether it ended or died on the way, replaces what it had registered and
        is told the same: it only yields to other batches.

        Nulls: a null text is the empty text; a null key loses to any other key and
        stays only where its group has no other. Repeated rows with one key and one
        text: exactly one stays. Other columns are ignored, so any names may occur.
        An empty batch gives no rows and leaves the index as it is.
        """
        if not re.fullmatch(r"[\w-]+", batch, re.ASCII):
            raise ValueError(f"not a batch name: {batch!r}")
        seen_rows = written(
            docs.select(F.col(key).cast("long").alias("key"), text_digest(F.col(text)).alias("digest"))
            .groupBy("digest", "key").agg(F.count(F.lit(1)).alias("repeats")), "digests")
        # Written, so that the joins meet one row per text: the optimizer would move them
        # below the aggregate and shuffle every copy to its digest.
        seen = written(seen_rows.groupBy("digest").agg(F.max("key").alias("keep_id"),
                                                       F.sum("repeats").alias("copies")), "seen")
        own = f"batch-{batch}"
        self._settle()
        names = [n for n in self.folders() if n != own]
        with self._tables(names) as tables:
            new = written(self.unseen(seen, tables, batch), "unseen") if tables else seen
            facts = new.select("digest", "keep_id", F.lit(True).alias("is_new"), F.col("copies").alias("group_size"))
            here = seen.select("digest", F.col("copies").alias("here"))
            for table in tables:
                known = here.join(table.filter(F.col("batch") != batch).hint("merge"), "digest")
                facts = facts.unionByName(known.select("digest", "keep_id", F.lit(False).alias("is_new"),
                                                       (F.col("here") + F.col("copies")).alias("group_size")))
            facts = written(facts, "facts")
            # A merged table may hold rows of this very batch, from before.
            for table in tables:
                new = new.join(table.filter(F.col("batch") == batch).select("digest").hint("merge"), "digest", "left_anti")
            self._store(new.select("digest", "keep_id", "copies", F.lit(batch).alias("batch")), own)
        if len(names) + 1 > MOST_TABLES:
            self.merge()
        decided = join_by_key(seen_rows, facts, "digest")
        return (decided.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")))
                .select(F.col("key").alias(key), "keep_id", F.col("group_size").cast("long"),
                        (F.col("is_new") & F.col("key").eqNullSafe(F.col("keep_id"))
                         & (F.col("nth") == 1)).alias("kept"), "digest"))
