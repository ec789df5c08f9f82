"""Deriving a confidence: token probabilities first, independent votes second."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.logprob import with_label_probability


def from_logprobs(decisions: DataFrame, key: str = "case_type",
                  value: str = "case_type") -> DataFrame:
    """Add ``logprob_confidence`` from the token stream of the deciding response."""
    return with_label_probability(decisions, "logprobs", value, key)


def self_consistency(decisions: DataFrame, votes: DataFrame,
                     keys: Sequence[str] = ("record_id",)) -> DataFrame:
    """Share of independent votes for the emitted label.

    The first answer is not a vote. One malformed vote voids the record: NULL
    with ``votes_valid`` false, because a smaller denominator would inflate it.
    """
    joined = votes.join(decisions.select(*keys, F.col("case_type").alias("_emitted")), list(keys))
    supports = F.when(F.col("case_type") == F.col("_emitted"), 1.0).otherwise(0.0)
    tally = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("votes"), F.bool_and("valid").alias("votes_valid"),
        F.avg(supports).alias("_share"))
    return tally.select(*keys, "votes", "votes_valid",
                        F.when(F.col("votes_valid"), F.col("_share")).alias("vote_confidence"))


def derive_confidence(decisions: DataFrame, tallies: DataFrame,
                      keys: Sequence[str] = ("record_id",)) -> DataFrame:
    """Confidence and the method that produced it; NULL method means no output."""
    joined = from_logprobs(decisions).join(tallies, list(keys), "left")
    by_tokens = F.col("logprob_confidence").isNotNull()
    return (joined
            .withColumn("confidence", F.coalesce("logprob_confidence", "vote_confidence"))
            .withColumn("confidence_method", F.when(by_tokens, "LOGPROBS").when(
                F.col("vote_confidence").isNotNull(), "SELF_CONSISTENCY")))
