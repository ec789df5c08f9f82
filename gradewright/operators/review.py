"""Review worklist and decisions on the pending queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.banding import shown_confidence
from ..functions.columns import strip
from ..sources.jsonl import merge_into_raw
from .sample import dense_positions


def worklist(queue: DataFrame, key: str = "record_id", levels: Sequence[int] = (4, 7)) -> DataFrame:
    """Undecided items in id order with position, total and truncated confidence."""
    pending = queue.filter(F.col("decision").isNull())
    total = pending.select(F.count(F.lit(1)).alias("n")).scalar()
    return (dense_positions(pending, key, levels).withColumn("total", total)
            .withColumn("shown_confidence", shown_confidence(F.col("confidence"))))


def is_valid_decision(draft: Column, allowed: Sequence[str] = fixed.DECISIONS) -> Column:
    """Known decision; an edit must bring text that differs from the draft."""
    text = F.col("reviewer_text")
    changed = text.isNotNull() & (strip(text) != strip(draft))
    return F.col("decision").isin(*allowed) & ((F.col("decision") != "edit") | changed)


def first_decisions(decisions: DataFrame, queue: DataFrame, order: Sequence[str] = ("ts",),
                    key: str = "record_id") -> DataFrame:
    """First valid decision per undecided item.

    Repeats of the same decision fold to their earliest row before the join, so
    a record with very many log rows does not skew it.
    """
    folded = decisions.groupBy(key, "decision", "reviewer_text").agg(
        F.min(F.struct(*order)).alias("_at"))
    open_ = queue.filter(F.col("decision").isNull()).select(key, F.col("draft_reply").alias("_draft"))
    valid = folded.join(open_, key).filter(is_valid_decision(F.col("_draft")))
    kept = F.when(F.col("decision") == "edit", F.col("reviewer_text"))
    return valid.groupBy(key).agg(F.min_by(
        F.struct("decision", kept.alias("reviewer_text")), "_at").alias("_d")).select(
        key, "_d.decision", "_d.reviewer_text")


def apply_decisions(queue: DataFrame, decided: DataFrame, key: str = "record_id") -> DataFrame:
    """New queue version; items decided earlier keep what they have, unknown fields stay."""
    new = decided.select(key, F.col("decision").alias("_decision"),
                         F.col("reviewer_text").alias("_text"))
    joined = queue.join(new, key, "left")
    fresh = F.col("decision").isNull() & F.col("_decision").isNotNull()
    updates = {"decision": F.when(fresh, F.col("_decision")).otherwise(F.col("decision")),
               "reviewer_text": F.when(fresh, F.col("_text")).otherwise(F.col("reviewer_text"))}
    if "raw" in queue.columns:
        updates["raw"] = F.when(fresh, merge_into_raw(
            F.col("raw"), {"decision": F.col("_decision"), "reviewer_text": F.col("_text")})
        ).otherwise(F.col("raw"))
    return joined.withColumns(updates).drop("_decision", "_text")


def review_counts(queue: DataFrame, decisions: DataFrame, order: Sequence[str] = ("ts",),
                  key: str = "record_id", allowed: Sequence[str] = fixed.DECISIONS) -> DataFrame:
    """Open items of the queue by what this log decides, items left pending, and those of them skipped.

    The log is folded as in ``first_decisions`` and joined once to the open items (one row
    per ``key``); the outcomes are a closed set, so all counts come from one aggregate.
    Outcomes without an item are absent, ``skipped`` is always there.
    """
    folded = decisions.groupBy(key, "decision", "reviewer_text").agg(
        F.min(F.struct(*order)).alias("_at"))
    open_ = queue.filter(F.col("decision").isNull()).select(key, F.col("draft_reply").alias("_draft"))
    valid = is_valid_decision(F.col("_draft"), allowed)
    items = open_.join(folded, key, "left").groupBy(key).agg(
        F.min_by("decision", F.when(valid, F.col("_at"))).alias("_first"),
        F.max(F.coalesce(F.col("decision") == "skip", F.lit(False))).alias("_skip"))
    pending = F.col("_first").isNull()
    counts = items.agg(
        *[F.count_if(F.col("_first") == d).alias(d) for d in allowed],
        F.count_if(pending).alias("pending"), F.count_if(pending & F.col("_skip")).alias("skipped"))
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("outcome"), F.col(c).alias("n")) for c in counts.columns]))
        ).filter("n > 0 OR outcome = 'skipped'")
