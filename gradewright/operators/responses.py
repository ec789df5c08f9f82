"""Response logs: validation, retry resolution and failure counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import contract

CALL = ("run_id", "record_id", "stage")
STAGE_FIELDS = {"triage": contract.TRIAGE_DECISION, "draft": contract.DRAFT_OUTPUT}


def validate_responses(log: DataFrame, raw: str = "raw",
                       contracts: dict[str, tuple] | None = None) -> DataFrame:
    """Each attempt with ``valid``, ``reason`` and typed fields of its stage's contract.

    The log is read and parsed once, whatever the number of stages. A provider
    error is no response and stays invalid.
    """
    return contract.parse_by(log, raw, F.col("stage"), contracts or STAGE_FIELDS)


def resolve_retries(attempts: DataFrame, bound: int = fixed.RESPONSE_ATTEMPTS,
                    keys: Sequence[str] = CALL, payload: Sequence[str] = (),
                    provider_error: str | None = "provider_error") -> DataFrame:
    """One row per call: the first valid attempt within the bound, or why there is none.

    outcome is ok / provider_error / exhausted / open (fewer failures than the
    bound so far). Only attempts before the deciding one count as failures, held
    as a bit per attempt number. A single mergeable aggregate, so a hot key is
    combined map-side and no call's rows are gathered in one place.
    """
    within = attempts.filter(F.col("attempt") <= bound)
    refused = (F.col(provider_error).isNotNull() if provider_error else F.lit(False))
    valid = F.col("valid") & ~refused
    failed = ~F.col("valid") & ~refused
    number = F.col("attempt")
    none = F.lit(bound + 1)
    grouped = within.groupBy(*keys).agg(
        F.min(F.when(valid, number)).alias("_ok"),
        F.min(F.when(refused, number)).alias("_refused"),
        F.bit_or(F.when(failed, F.call_function("shiftleft", F.lit(1), number - 1)).otherwise(0)).alias("_failed"),
        *[F.min_by(F.when(valid, F.col(p)), F.when(valid, number)).alias(p) for p in payload])
    decided = F.least(F.coalesce("_ok", none), F.coalesce("_refused", none))
    before = F.expr("bit_count(_failed & (shiftleft(1, _decided - 1) - 1))")
    staged = grouped.withColumn("_decided", decided).withColumn("failed_attempts", before)
    won = F.coalesce(F.col("_ok") == F.col("_decided"), F.lit(False))
    refused_first = F.coalesce(F.col("_refused") == F.col("_decided"), F.lit(False)) & ~won
    return staged.select(
        *keys,
        F.when(won, "ok").when(refused_first, "provider_error")
        .when(F.col("failed_attempts") >= bound, "exhausted").otherwise("open").alias("outcome"),
        F.when(won | refused_first, F.col("_decided")).alias("attempt"),
        F.col("failed_attempts"),
        *[F.when(won, F.col(p)).alias(p) for p in payload])


def retry_notes(attempts: DataFrame, bound: int = fixed.RESPONSE_ATTEMPTS,
                keys: Sequence[str] = CALL) -> DataFrame:
    """Failure text each attempt is told about: the reason of the attempt before it.

    Copies of the same attempt are folded first, so a window partition holds at
    most ``bound`` rows.
    """
    folded = (attempts.filter(F.col("attempt") <= bound).groupBy(*keys, "attempt")
              .agg(F.min("reason").alias("reason")))
    order = Window.partitionBy(*keys).orderBy("attempt")
    return folded.withColumn("previous_failure", F.lag("reason").over(order))


def retryable_ratings(scores: DataFrame, bound: int = fixed.RATER_ATTEMPTS,
                      keys: Sequence[str] = ("combination", "record_id", "metric")) -> DataFrame:
    """Rater outcome per task: only a missing score is retried, once.

    Any other error on the first attempt is final. ``retries`` counts the extra
    attempt that was made.
    """
    missing = F.col("error") == "missing score"
    usable = scores.filter(F.col("attempt") <= bound)
    grouped = usable.groupBy(*keys).agg(
        F.min_by(F.struct("score", "error"), "attempt").alias("_first"),
        F.max_by(F.struct("score", "error"), F.when(F.col("attempt") == bound, 1)).alias("_last"),
        F.min(F.when(F.col("attempt") == 1, missing)).alias("_retry"))
    used = F.when(F.coalesce("_retry", F.lit(False)) & F.col("_last").isNotNull(),
                  F.col("_last")).otherwise(F.col("_first"))
    return grouped.select(
        *keys, used["score"].alias("score"), used["error"].alias("error"),
        F.when(F.coalesce("_retry", F.lit(False)) & F.col("_last").isNotNull(), 1)
        .otherwise(0).alias("retries"))


def failure_counts(resolved: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Failed attempts, exhausted calls and provider errors: three separate counts."""
    return resolved.groupBy(*keys).agg(
        F.sum("failed_attempts").cast("bigint").alias("schema_failures"),
        F.count_if(F.col("outcome") == "exhausted").alias("retry_exhaustions"),
        F.count_if(F.col("outcome") == "provider_error").alias("provider_refusals"))


def schema_failure_rate(resolved: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Failed attempts over two calls per record (at least one)."""
    records = F.count_if(F.col("stage") == "triage")
    failures = F.sum("failed_attempts")
    return resolved.groupBy(*keys).agg(
        records.alias("records"), failures.cast("bigint").alias("schema_failures"),
        (failures / F.greatest(records * 2, F.lit(1))).alias("schema_failure_rate"))


def build_outputs(resolved: DataFrame, keys: Sequence[str] = ("run_id", "record_id")) -> DataFrame:
    """One row per record whose triage and draft both succeeded, plus the failed ids.

    ``failed_stage`` is NULL on produced outputs. Input carries the resolved
    triage fields (case_type, priority) and draft fields (summary, draft_reply).
    """
    ok = F.col("outcome") == "ok"
    triage, draft = F.col("stage") == "triage", F.col("stage") == "draft"
    grouped = resolved.groupBy(*keys).agg(
        F.max(F.when(triage & ok, F.col("case_type"))).alias("case_type"),
        F.max(F.when(triage & ok, F.col("priority"))).alias("priority"),
        F.max(F.when(draft & ok, F.col("summary"))).alias("summary"),
        F.max(F.when(draft & ok, F.col("draft_reply"))).alias("draft_reply"),
        F.coalesce(F.bool_or(triage & ok), F.lit(False)).alias("_t"),
        F.coalesce(F.bool_or(draft & ok), F.lit(False)).alias("_d"))
    made = F.col("_t") & F.col("_d")
    return grouped.select(
        *keys, *[F.when(made, F.col(c)).alias(c)
                 for c in ("case_type", "priority", "summary", "draft_reply")],
        F.when(~F.col("_t"), "triage").when(~F.col("_d"), "draft").alias("failed_stage"))
