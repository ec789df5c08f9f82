"""Queries: structured-streaming jobs, run over everything available and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import responses
from ..session import shared_dir
from ..sources import merge
from ..streaming import folds, retries, runs, traces
from .checks import DECIDED_CTE
from .intake import RESOLVED_CTE
from .quality import r9
from .registry import Tables, query
from .texts import KEY


class StreamTables(Tables):
    """The same views over a stream of the base table's files."""

    options: dict[str, str] = {}

    def base(self, name: str):
        """A stream of the table's files, whether the table is one file or a folder of them.

        The pattern matches just the table's path; reading the schema fails if it is missing.
        """
        schema = super().base(name).schema
        return (self.spark.readStream.schema(schema).options(**self.options)
                .parquet(f"{self.folder}/{name}.parque[t]"))


def _append(t: Tables, stream, purpose: str):
    out = shared_dir(t.spark, purpose)
    runs.start(stream, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{out}/table")


def _fold(t: Tables, stream, initial, step, purpose: str, part, mode: str = "update"):
    out = shared_dir(t.spark, purpose)
    table = runs.PartTable(t.spark, f"{out}/table", part)
    table.create(initial)
    runs.start_folds(stream, table, f"{out}/checkpoint", step, mode).awaitTermination()
    return table.latest()


def _streamed(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.folder)


def _unsealed(t: Tables):
    return _streamed(t).view("traces").select(
        "record_id", "stage", F.when(F.col("event_id") % 100 != 7, F.col("model")).alias("model"),
        "seconds", F.concat(F.lit("prompt "), F.col("event_id").cast("string")).alias("prompt"),
        F.lit("").alias("response"))


def _sealed(t: Tables):
    return _append(t, traces.sealed_traces(_unsealed(t), KEY), "traces")


@query("t1_rejected_traces", """
    SELECT record_id, stage, seconds, true AS hidden FROM traces WHERE event_id % 100 = 7""")
def _(t):
    rejected = _append(t, traces.sealed_rejects(_unsealed(t), KEY), "rejects")
    return rejected.select("record_id", "stage", "seconds",
                           (~F.contains("prompt", F.lit("prompt"))).alias("hidden"))


@query("t1_trace_ingest", """
    SELECT record_id, stage, model, seconds, '' AS response, true AS hidden FROM traces
    WHERE event_id % 100 <> 7""")
def _(t):
    return _sealed(t).withColumn("hidden", ~F.contains(F.col("prompt"), F.lit("prompt"))
                                 & (F.length("prompt") > 20)).drop("prompt")


@query("s6_trace_append", "SELECT count(*) AS n FROM traces WHERE event_id % 100 <> 7")
def _(t):
    return _sealed(t).groupBy().agg(F.count(F.lit(1)).alias("n"))


@query("t2_queue_stream", f"WITH {DECIDED_CTE} SELECT record_id, decision, reviewer_text FROM state")
def _(t):
    step = folds.queue_step(("ts", "event_id"))
    queue = t.view("queue").select("record_id", "draft_reply", "decision", "reviewer_text")
    return _fold(t, _streamed(t).view("decisions"), queue, step, "queue",
                 runs.hash_part(["record_id"]), "append").select(
        "record_id", "decision", "reviewer_text")


@query("t3_retry_stream", f"""WITH {RESOLVED_CTE},
    times AS (SELECT run_id, record_id, stage, max(ts) AS last FROM responses GROUP BY 1, 2, 3)
    SELECT r.run_id, r.record_id, r.stage, outcome, attempt, failed_attempts,
           coalesce(case_type, draft_reply) AS payload
    FROM resolved r JOIN times t ON t.run_id = r.run_id AND t.record_id = r.record_id AND t.stage = r.stage
    WHERE outcome <> 'open'
       OR epoch_ms(last) + {3 * 3_600_000} <= (SELECT max(epoch_ms(ts)) FROM responses)""")
def _(t):
    """Decided calls as they are decided; open ones once two hours have passed without an attempt."""
    checked = responses.validate_responses(_streamed(t).view("responses")).withColumn(
        "payload", F.coalesce("case_type", "draft_reply")).withColumn("at", runs.event_time("ts"))
    before = t.spark.conf.get(retries.PROVIDER)
    t.spark.conf.set(retries.PROVIDER, retries.ROCKSDB)
    try:
        return _append(t, retries.resolve_stream(checked, timeout_ms=2 * 3_600_000, delay="1 hour"), "retries")
    finally:
        t.spark.conf.set(retries.PROVIDER, before)


_HOUR = 3_600_000_000


def _timed(t: Tables):
    """Traces with UTC event time; every 50th row arrives three hours late."""
    rows = _streamed(t).view("traces").withColumn("at", runs.event_time("ts"))
    return rows.withColumn("arrived", F.when(
        F.col("event_id") % 50 == 0, F.col("at") + F.expr("INTERVAL 3 HOURS")).otherwise(F.col("at")))


_ROLL = """SELECT CAST({w} AS BIGINT) AS window_start, stage,
    count(*) FILTER (WHERE event_id % 50 <> 0) AS calls,
    count(*) FILTER (WHERE event_id % 50 <> 0 AND NOT success) AS failures,
    round(sum(seconds) FILTER (WHERE event_id % 50 <> 0), 6) AS seconds,
    max(seconds) FILTER (WHERE event_id % 50 <> 0) AS slowest,
    CAST(sum(prompt_tokens + completion_tokens) FILTER (WHERE event_id % 50 <> 0) AS BIGINT) AS tokens,
    count(*) FILTER (WHERE event_id % 50 = 0) AS late
  FROM {t} GROUP BY 1, 2"""


def _rolled(t: Tables, width: str, slide: str | None = None):
    """On-time rows: windows changed by a batch replace their earlier row, and old state is
    dropped by watermark. The table is kept by months, so windows long closed are not rewritten. Late rows: counts per window, added up batch by batch."""
    keys = ["window_start", "stage"]

    def flat(frame, *columns):
        return frame.select(F.unix_micros("window.start").alias("window_start"), "stage", *columns)

    marked = traces.split_late(_timed(t), "at", "arrived", "1 HOUR")
    stream = flat(traces.rolling_operations(marked, "at", ["stage"], width, slide), "calls", "failures",
                  F.round("seconds", 6).alias("seconds"), "slowest", "tokens")
    month = runs.range_part("window_start", 30 * 24 * _HOUR)
    on_time = _fold(t, stream, t.spark.createDataFrame([], stream.schema),
                    lambda state, batch: merge.merge_by_key(state, batch, keys), "rolling", month)
    late = flat(traces.late_rows(marked, "at", ["stage"], width, slide))
    counts = _fold(t, late, t.spark.createDataFrame([], "window_start BIGINT, stage STRING, late BIGINT"),
                   folds.count_step(keys, "late"), "late", month, "append")
    return on_time.join(counts, keys, "full_outer").select(
        *keys, F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("failures", F.lit(0)).alias("failures"),
        "seconds", "slowest", "tokens", F.coalesce("late", F.lit(0)).alias("late"))


@query("t4_tumbling_operations", _ROLL.replace(
    "{w}", f"floor(micros / {24 * _HOUR}) * {24 * _HOUR}").replace("{t}", "traces"))
def _(t):
    return _rolled(t, "24 hours")


@query("t4_sliding_operations", _ROLL.replace("{w}", "start").replace("{t}", f"""(
    SELECT x.*, floor(micros / {12 * _HOUR}) * {12 * _HOUR} - back * {12 * _HOUR} AS start
    FROM traces x CROSS JOIN (VALUES (0), (1)) b(back)) s"""))
def _(t):
    return _rolled(t, "24 hours", "12 hours")


@query("t5_stage_correlation", f"""
    SELECT a.record_id, a.seconds AS triage_seconds, b.seconds AS draft_seconds,
           round(a.seconds + b.seconds, 6) AS end_to_end
    FROM traces a JOIN traces b ON a.record_id = b.record_id AND a.stage = 'triage' AND b.stage = 'draft'
     AND b.micros >= a.micros AND b.micros <= a.micros + {_HOUR}""")
def _(t):
    rows = _timed(t).select("record_id", "stage", "at", "seconds")
    again = _timed(t).select("record_id", "stage", "at", "seconds")
    joined = traces.correlate_stages(rows.filter("stage = 'triage'"),
                                     again.filter("stage = 'draft'"), "1 HOUR")
    return _append(t, joined, "stages").select(
        "record_id", "triage_seconds", "draft_seconds",
        F.round("end_to_end", 6).alias("end_to_end"))


def _sums(t: Tables):
    scores = _streamed(t).view("cell_ratings").select("combination", "metric",
                                                      F.col("hit").alias("score"))
    keys = ["combination", "metric"]
    return _fold(t, scores, folds.empty_sums(t.spark, keys), folds.sums_step(keys), "cells",
                 runs.hash_part(keys, 16), "append")


@query("t6_running_cell_means", """
    SELECT combination, metric, count(*) AS n, round(sum(hit) / CAST(count(*) AS DOUBLE), 9) AS value
    FROM cell_ratings GROUP BY 1, 2""")
def _(t):
    return r9(_sums(t).withColumn("value", F.col("total") / F.col("n")).drop("total"), "value")


@query("t6_finished_cells", """
    SELECT combination FROM (SELECT combination, metric, count(*) AS n FROM cell_ratings GROUP BY 1, 2)
    GROUP BY 1 HAVING count(*) FILTER (WHERE n >= 850) >= 4""")
def _(t):
    return folds.finished_cells(_sums(t), 850, "combination", 4)
