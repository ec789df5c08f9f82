"""Trace streams: encrypted ingestion, rolling operations, two-stage correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.redact import encrypt

REQUIRED = ("record_id", "stage", "model")


def _whole(required: Sequence[str]) -> Column:
    ok = F.lit(True)
    for name in required:
        ok = ok & F.col(name).isNotNull() & (F.length(name) > 0)
    return ok


def valid_traces(stream: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Traces that name their record, stage and model."""
    return stream.filter(_whole(required))


def rejected_traces(stream: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """The other traces, for a stream of their own."""
    return stream.filter(~F.coalesce(_whole(required), F.lit(False)))


def sealed_traces(stream: DataFrame, key: str | None = None) -> DataFrame:
    """Validate, then encrypt every sensitive column before anything reaches a sink."""
    return encrypt(valid_traces(stream), key)


def sealed_rejects(stream: DataFrame, key: str | None = None) -> DataFrame:
    """Rejected traces, encrypted like the others, so that none is lost."""
    return encrypt(rejected_traces(stream), key)


def split_late(stream: DataFrame, at: str, arrived: str, delay: str) -> DataFrame:
    """Mark rows that arrived later than the delay, so they can be counted apart."""
    return stream.withColumn("late", F.col(arrived) > F.col(at) + F.expr(f"INTERVAL {delay}"))


def _span(at: str, width: str, slide: str | None) -> Column:
    return (F.window(at, width, slide) if slide else F.window(at, width)).alias("window")


def rolling_operations(stream: DataFrame, at: str, keys: Sequence[str], width: str,
                       slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Calls, failures, latency sums, maxima and tokens of on-time rows per event-time window.

    All aggregates are mergeable, so state per window and key is a few numbers, dropped
    by the watermark. Late rows are left to ``late_rows``: the watermark may already have
    passed their window.
    """
    return (stream.filter(~F.col("late")).withWatermark(at, delay)
            .groupBy(_span(at, width, slide), *keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(~F.col("success")).alias("failures"),
        F.sum("seconds").alias("seconds"), F.max("seconds").alias("slowest"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens")))


def late_rows(stream: DataFrame, at: str, keys: Sequence[str], width: str,
              slide: str | None = None) -> DataFrame:
    """Late rows with each window they fall into: no watermark and no state, so none is lost.

    Count them batch by batch (``folds.count_step``).
    """
    return stream.filter("late").select(_span(at, width, slide), *keys)


def correlate_stages(triage: DataFrame, draft: DataFrame, bound: str, delay: str = "1 hour",
                     unpaired: bool = False) -> DataFrame:
    """Triage joined to the draft of the same record within a time bound.

    Both sides carry ``record_id``, ``at`` and ``seconds``; the time range lets
    Spark drop join state once no partner can arrive any more. With ``unpaired`` a triage
    whose draft never came is emitted then, its draft columns and ``end_to_end`` null.
    """
    left = triage.select("record_id", F.col("at").alias("triage_at"),
                         F.col("seconds").alias("triage_seconds")).withWatermark("triage_at", delay)
    right = draft.select(F.col("record_id").alias("draft_record"), F.col("at").alias("draft_at"),
                         F.col("seconds").alias("draft_seconds")).withWatermark("draft_at", delay)
    joined = left.join(right, F.expr(f"""record_id = draft_record AND draft_at >= triage_at
        AND draft_at <= triage_at + INTERVAL {bound}"""), "left_outer" if unpaired else "inner")
    return joined.withColumn(
        "end_to_end", F.col("triage_seconds") + F.col("draft_seconds")).drop("draft_record")
