"""Small helpers shared by the streaming jobs."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

VERSION = "version"


def event_time(ts: str) -> Column:
    """Zone-less timestamp read as UTC, as watermarks need a TIMESTAMP."""
    return F.timestamp_micros(F.timestamp_diff(
        "MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts)))


def start(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Append the stream to a parquet table exactly once, over all data available now."""
    return (stream.writeStream.format("parquet").outputMode(mode).option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def hash_part(keys: Sequence[str], parts: int = 64) -> Column:
    """Part of a table by hash of its key."""
    return F.pmod(F.xxhash64(*keys), F.lit(parts))


def range_part(at: str, width: int) -> Column:
    """Part of a table by stretches of a number, such as the start of a window.

    Parts that no row comes to any more are never written again.
    """
    return F.floor(F.col(at) / F.lit(width)).cast("long")


class PartTable:
    """A table in versions, of which a new one rewrites only the parts it changes.

    ``data/version=n/_part=k`` holds part k as version n wrote it; ``manifest/n.json``
    says for version n which version wrote each of its parts, and is put in place by a
    rename once the data are complete. A reader follows the newest manifest.
    """

    def __init__(self, spark: SparkSession, root: str, part: Column) -> None:
        self.spark, self.root, self.part = spark, root, part

    # -- files -------------------------------------------------------------------
    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *names)))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *names: str) -> list[str]:
        files, path = self._files(), self._path(*names)
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def versions(self) -> list[int]:
        """Versions whose manifest is in place, ascending."""
        return sorted(int(n[:-5]) for n in self._names("manifest") if re.fullmatch(r"\d+\.json", n))

    def _manifest(self, version: int) -> dict:
        path = self._path("manifest", f"{version:09d}.json").toString()
        text = self.spark.read.text(path, wholetext=True).first()[0]
        return json.loads(text)

    def _publish(self, version: int, parts: dict[str, int], schema: str) -> None:
        files = self._files()
        made, place = self._path("manifest", f"_{version:09d}"), self._path("manifest", f"{version:09d}.json")
        out = files.create(made, True)
        out.write(bytearray(json.dumps({"parts": parts, "schema": schema}).encode()))
        out.close()
        files.delete(place, False)
        if not files.rename(made, place):
            raise OSError(f"cannot publish version {version} of {self.root}")

    # -- rows --------------------------------------------------------------------
    def _rows(self, manifest: dict, wanted: set[str] | None = None) -> DataFrame:
        paths = [self._path("data", f"{VERSION}={v:09d}", f"_part={k}").toString()
                 for k, v in sorted(manifest["parts"].items()) if wanted is None or k in wanted]
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        return (self.spark.read.schema(schema).parquet(*paths) if paths
                else self.spark.createDataFrame([], schema))

    def _write(self, rows: DataFrame, version: int) -> list[str]:
        """Write the rows' parts under a version; return their names."""
        path = self._path("data", f"{VERSION}={version:09d}")
        (rows.withColumn("_part", self.part).repartition("_part").write.mode("overwrite")
         .partitionBy("_part").parquet(path.toString()))
        return [n.split("=")[1] for n in self._names("data", f"{VERSION}={version:09d}") if n.startswith("_part=")]

    def create(self, rows: DataFrame) -> None:
        """Version 0."""
        self._publish(0, dict.fromkeys(self._write(rows, 0), 0), rows.schema.json())

    def latest(self) -> DataFrame:
        """The newest complete version, whichever run wrote it."""
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"no complete version under {self.root}")
        return self._rows(self._manifest(found[-1]))

    def fold(self, batch: DataFrame, number: int, step: Callable[[DataFrame, DataFrame], DataFrame],
             keep: int = 2) -> None:
        """Version ``number + 1``: the parts the batch has rows for, stepped; the others as they are.

        ``step`` must keep rows in the part of their key. A replayed batch starts from the
        version before its own and writes the same again.
        """
        manifest = self._manifest(number)
        # At most one name per part; the batch's rows are not brought here.
        touched = {str(r[0]) for r in batch.select(self.part).distinct().collect()}
        parts = {k: v for k, v in manifest["parts"].items() if k not in touched}
        if touched:
            rows = step(self._rows(manifest, touched), batch)
            parts |= dict.fromkeys(self._write(rows, number + 1), number + 1)
        self._publish(number + 1, parts, manifest["schema"])
        self._forget(number + 1, keep)

    def _forget(self, newest: int, keep: int) -> None:
        """Drop manifests before the last ``keep`` and the parts that no kept one names."""
        files = self._files()
        old = [v for v in self.versions() if v <= newest - keep]
        if not old:
            return
        used = {(int(v), k) for n in self.versions() if n > newest - keep for k, v in self._manifest(n)["parts"].items()}
        for n in old:
            for k, v in self._manifest(n)["parts"].items():
                if (v, k) not in used:
                    files.delete(self._path("data", f"{VERSION}={v:09d}", f"_part={k}"), True)
            files.delete(self._path("manifest", f"{n:09d}.json"), False)


def start_folds(stream: DataFrame, table: PartTable, checkpoint: str,
                step: Callable[[DataFrame, DataFrame], DataFrame], mode: str = "update",
                keep: int = 2) -> StreamingQuery:
    """Fold micro-batches into a table: version n+1 = version n with batch n's parts stepped.

    What a batch writes follows the parts it has rows for, not the table. A version never
    overwrites what the one before it reads, and a replayed batch rewrites only its own, so the
    fold is idempotent. The table must have been created. The last ``keep`` versions stay (two at
    least: a batch that is replayed after a failure reads the one before its own).
    """
    if keep < 2:
        raise ValueError("keep at least two versions")
    return (stream.writeStream.outputMode(mode)
            .foreachBatch(lambda batch, number: PartTable(batch.sparkSession, table.root, table.part)
                          .fold(batch, number, step, keep))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
