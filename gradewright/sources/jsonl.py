"""JSON Lines at the edges: strict scans, open scans and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import contract
from ..functions.columns import fail_on, strip


def strict_lines(lines: DataFrame, spec: Sequence[contract.Field],
                 value: str = "value") -> DataFrame:
    """Parse text lines against a contract; blank lines are skipped.

    Adds ``valid``, ``reason`` and the typed fields. The plain JSON reader is not
    strict enough for this: it ignores unknown keys and turns numbers into text.
    """
    filled = lines.filter(F.length(strip(value)) > 0)
    return contract.parse(filled, value, tuple(spec))


def duplicate_keys(rows: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    keys = [key] if isinstance(key, str) else list(key)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def line_violations(parsed: DataFrame, key: str = "id") -> DataFrame:
    """Bad lines and duplicate ids as (key, rule, detail)."""
    bad = parsed.filter(~F.col("valid")).select(
        F.col("line_no").cast("string").alias("key"), F.lit("bad line").alias("rule"),
        F.col("reason").alias("detail"))
    twice = duplicate_keys(parsed.filter("valid"), key).select(
        F.col(key).alias("key"), F.lit("duplicate id").alias("rule"),
        F.col("n").cast("string").alias("detail"))
    return bad.unionByName(twice)


def read_strict(spark: SparkSession, path: str, spec: Sequence[contract.Field],
                key: str = "id", fail: bool = True) -> DataFrame:
    """Strict scan of a JSON Lines file; one bad line or duplicate id fails the load."""
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    parsed = strict_lines(lines, spec)
    if fail:
        fail_on(line_violations(parsed, key), path)
    return parsed.filter("valid").select(*[f.name for f in spec])


def read_queue(lines: DataFrame, value: str = "value",
               schema: T.StructType = schemas.QUEUE) -> DataFrame:
    """Queue lines as typed columns, with the whole line kept so no field is lost."""
    filled = lines.filter(F.length(strip(value)) > 0)
    return filled.select(F.from_json(F.col(value), schema).alias("_q"),
                         F.col(value).alias("raw")).select("_q.*", "raw")


def merge_into_raw(raw: Column, updates: Mapping[str, Column]) -> Column:
    """Raw JSON object with some text fields set and every other field kept as written.

    Each kept value is spliced back as JSON text, so numbers, arrays and nested
    objects the engine knows nothing about survive unchanged in value.
    """
    def quoted(c: Column) -> Column:
        boxed = F.to_json(F.array(c.cast("string")))
        return F.coalesce(F.when(c.isNotNull(), F.substring(
            boxed, F.lit(2), F.length(boxed) - 2)), F.lit("null"))

    fields = F.from_json(raw, "map<string,variant>")
    kept = F.map_entries(F.map_filter(fields, lambda k, _: ~k.isin(*updates)))
    old = F.transform(kept, lambda e: F.concat(
        quoted(e["key"]), F.lit(":"), F.coalesce(F.to_json(e["value"]), F.lit("null"))))
    new = F.array(*[F.concat(F.lit(f'"{n}":'), quoted(c)) for n, c in updates.items()])
    return F.concat(F.lit("{"), F.array_join(F.concat(old, new), ","), F.lit("}"))


def queue_rows(outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split produced outputs (pending decision) from failed record ids."""
    made = outputs.filter(F.col("failed_stage").isNull()).drop("failed_stage")
    pending = (made.withColumn("decision", F.lit(None).cast("string"))
               .withColumn("reviewer_text", F.lit(None).cast("string")))
    return pending, outputs.filter(F.col("failed_stage").isNotNull()).select(
        "record_id", "failed_stage")


def write_json(rows: DataFrame, path: str, order: Sequence[str] = ("record_id",)) -> None:
    """Ordered JSON Lines sink; a range-partitioned sort, one file per range."""
    rows.orderBy(*order).write.option("ignoreNullFields", "false").json(path)


def split_halves(records: DataFrame, inputs: Sequence[str], answers: Sequence[str],
                 key: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """Label-isolating split: the pipeline's half holds no label column."""
    shared = set(inputs) & set(answers)
    if shared:
        raise ValueError(f"columns in both halves: {sorted(shared)}")
    return records.select(key, *inputs), records.select(key, *answers)


def result_documents(cells: DataFrame, scores: DataFrame,
                     keys: Sequence[str]) -> DataFrame:
    """One nested document per matrix cell: a score map beside the cell columns."""
    nested = scores.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("scores"))
    return cells.join(nested, list(keys), "left")
