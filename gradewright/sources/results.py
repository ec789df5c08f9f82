"""Result documents: one per cell, written cell by cell with a digest, read back to resume."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import gate

DIGEST = "digest"


def _part(rows: DataFrame | None, keys: Sequence[str], part: str, name: str, value: str,
          bar: str | None = None) -> DataFrame | None:
    if rows is None:
        return None
    return rows.select(
        *keys, F.lit(part).alias("part"), F.col(name).alias("name"),
        F.col(value).cast("double").alias("value") if part in ("scores", "breaches")
        else F.lit(None).cast("double").alias("value"),
        F.col(value).cast("bigint").alias("n") if part in ("counts", "failures")
        else F.lit(None).cast("bigint").alias("n"),
        (F.col(bar).cast("double") if bar else F.lit(None).cast("double")).alias("bar"))


def documents(scores: DataFrame, counts: DataFrame, failures: DataFrame, breaches: DataFrame,
              composites: DataFrame, settings: Mapping[str, str],
              keys: Sequence[str] = gate.CELL) -> DataFrame:
    """One nested document per cell of ``composites``.

    ``scores`` is long (keys, metric, value), ``counts`` and ``failures`` (keys, name, n),
    ``breaches`` as the gate gives them; ``composites`` has the cell's keys and its composite
    columns, which go into the document as they are. The four long tables meet in one
    aggregate; a cell's maps hold one entry per metric, not per record, and a name given
    twice fails. What grows with the records (their scores, reasons, missing outputs) stays
    in tables partitioned by the same keys. ``settings`` are those a resume has to share.
    """
    parts = [_part(scores, keys, "scores", "metric", "value"),
             _part(counts, keys, "counts", "name", "n"), _part(failures, keys, "failures", "name", "n"),
             _part(breaches, keys, "breaches", "metric", "value", "bar")]
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)

    def entries(part: str, *fields: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct(*fields))))

    nested = long.groupBy(*keys).agg(
        F.map_from_entries(entries("scores", "name", "value")).alias("scores"),
        F.map_from_entries(entries("counts", "name", "n")).alias("counts"),
        F.map_from_entries(entries("failures", "name", "n")).alias("failures"),
        entries("breaches", "name", "value", "bar").alias("breaches"))
    kept = composites.join(nested, list(keys), "left")
    for name in ("scores", "counts", "failures", "breaches"):
        empty = F.create_map() if name != "breaches" else F.array()
        kept = kept.withColumn(name, F.coalesce(name, empty.cast(nested.schema[name].dataType)))
    shared = F.create_map(*[F.lit(x) for k in sorted(settings) for x in (k, str(settings[k]))])
    return with_digest(kept.withColumn("settings", shared))


def with_digest(rows: DataFrame) -> DataFrame:
    """Add the SHA-256 of a document's JSON text, its columns in name order."""
    names = sorted(c for c in rows.columns if c != DIGEST)
    text = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return rows.withColumn(DIGEST, F.sha2(text, 256))


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Stored documents; none where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def damaged(stored: DataFrame) -> DataFrame:
    """Documents whose content is not what their digest says."""
    told = stored.withColumn("_told", F.col(DIGEST)).drop(DIGEST)
    names = [c for c in stored.columns if c != DIGEST]
    text = F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})
    return (told.filter(~F.sha2(text, 256).eqNullSafe(F.col("_told")))
            .withColumnRenamed("_told", DIGEST).select(*stored.columns))


def write_documents(rows: DataFrame, path: str, keys: Sequence[str] = gate.CELL) -> None:
    """Write one folder per cell; only cells whose digest is new are replaced.

    Each replaced folder is swapped in when the job commits, so a run that dies leaves the
    former documents, and a run repeated writes nothing.
    """
    stored = read_documents(rows.sparkSession, path, rows.schema)
    changed = rows.join(stored.select(*keys, DIGEST), [*keys, DIGEST], "left_anti").select(*rows.columns)
    (changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*keys).parquet(path))


def cell_counts(stored: DataFrame, keys: Sequence[str] = gate.CELL) -> DataFrame:
    """Counts of stored documents in the long form that ``gate.complete_cells`` reads."""
    name = F.col("name")
    kind = (F.when(name == "scored", "scored").when(F.endswith(name, F.lit(" scored")), "rated"))
    counts = stored.select(*keys, F.explode("counts").alias("name", "n")).select(
        *keys, kind.alias("kind"), F.regexp_replace(name, " scored$", "").alias("name"), "n")
    errors = stored.select(*keys, F.explode("failures").alias("name", "n")).filter(
        F.endswith(name, F.lit(" errors"))).select(*keys, F.lit("error").alias("kind"), "name", "n")
    return counts.filter(F.col("kind").isNotNull()).unionByName(errors)


def refuse_other_settings(stored: DataFrame, settings: Mapping[str, str]) -> DataFrame:
    """The stored documents; reading one made under another setting fails the job.

    The check is part of the plan, so it costs no pass of its own.
    """
    out = stored
    for key in sorted(settings):
        held = F.try_element_at("settings", F.lit(key))
        out = out.filter(F.when(held.eqNullSafe(F.lit(str(settings[key]))), True).otherwise(
            F.raise_error(F.concat(F.lit(f"resume conflict: {key} is "), F.coalesce(held, F.lit("not set")),
                                   F.lit(f", not {settings[key]}"))).cast("boolean")))
    return out


def cells_to_resume(stored: DataFrame, wanted: DataFrame, settings: Mapping[str, str],
                    records: int | Column, judged: int | Column, metrics: Sequence[str],
                    keys: Sequence[str] = gate.CELL) -> DataFrame:
    """Wanted cells without a complete stored document made under the same settings."""
    same = refuse_other_settings(stored, settings)
    done = gate.complete_cells(cell_counts(same, keys), records, judged, metrics, keys)
    return gate.cells_to_run(wanted, done, keys)
