"""Latency, tokens and cost from call traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import from_ordered_bits, ordered_bits


def drop_warmups(records: DataFrame, warmups: int, run: str = "run_id",
                 order: str = "record_id") -> DataFrame:
    """Drop the first ``warmups`` successful records of each run, and all failed ones.

    Only the cut-off per run is ranked (a group limit pushed below the shuffle),
    so a run that holds most rows never lands in one task.
    """
    good = records.filter("success")
    if warmups <= 0:
        return good
    rank = F.row_number().over(Window.partitionBy(run).orderBy(order))
    edge = (good.select(run, order).withColumn("_rank", rank).filter(F.col("_rank") <= warmups)
            .groupBy(run).agg(F.max(order).alias("_edge")))
    return good.join(edge, run).filter(F.col(order) > F.col("_edge")).drop("_edge")


def _locate(targets: DataFrame, counts: DataFrame, within: Sequence[str], cell: str) -> DataFrame:
    """Targets moved into the cell of ``counts`` that holds their rank.

    ``rank`` becomes the rank inside that cell. The window runs over the cells of one group.
    """
    upto = Window.partitionBy(*within).orderBy(cell).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ends = counts.withColumn("_end", F.sum("_c").over(upto)).withColumn("_start", F.col("_end") - F.col("_c"))
    rank = F.col("rank")
    return (targets.join(ends, list(within)).filter((rank > F.col("_start")) & (rank <= F.col("_end")))
            .withColumn("rank", rank - F.col("_start")).drop("_start", "_end", "_c"))


def exact_ranks(values: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column],
                shifts: Sequence[int] = (40, 20, 0)) -> DataFrame:
    """Values at given 1-based ranks per key, exactly, by selection level by level.

    ``ranks`` maps a name to a rank expression over ``_n`` (rows per key). Values become
    integers of the same order. The first level counts the cells of their leading bits
    (4,096 for each power of two); rows of the cells hit by a rank are read once more and
    reduced to distinct values, and each further level splits a hit cell into 2^20. At the
    last shift, 0, a cell is one value. Counts combine map-side, and no window sees more
    cells than one level has, whatever the range of the values or the rows of a key.
    NULL values are left out; NaN counts as the largest.
    """
    keys, first = list(keys), "_b0"
    known = values.filter(F.col(value).isNotNull()).select(
        *keys, ordered_bits(F.col(value)).alias("_k")).withColumn(first, F.shiftright("_k", shifts[0]))
    coarse = known.groupBy(*keys, first).agg(F.count(F.lit(1)).alias("_c"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank"))
                       for name, rank in ranks.items()])
    asked = (coarse.groupBy(*keys).agg(F.sum("_c").alias("_n"))
             .select(*keys, "_n", F.inline(wanted)))
    targets = _locate(asked, coarse, keys, first)
    inside = (known.join(targets.select(*keys, first).distinct(), [*keys, first], "left_semi")
              .groupBy(*keys, first, "_k").agg(F.count(F.lit(1)).alias("_c")))
    above = first
    for level, shift in enumerate(shifts[1:], 1):
        cell = f"_b{level}"
        inside = inside.withColumn(cell, F.shiftright("_k", shift))
        hit = inside if above == first else inside.join(
            targets.select(*keys, above).distinct(), [*keys, above], "left_semi")
        counts = hit.groupBy(*keys, above, cell).agg(F.sum("_c").alias("_c"))
        targets = _locate(targets, counts, [*keys, above], cell).drop(above)
        above = cell
    return targets.groupBy(*keys).agg(
        F.max("_n").alias("n"),
        *[F.max(F.when(F.col("name") == name, from_ordered_bits(F.col(above)))).alias(name) for name in ranks])


def stage_latency(samples: DataFrame, keys: Sequence[str], seconds: str = "seconds") -> DataFrame:
    """n, exact median (mean of the middle two) and nearest-rank p95 per key."""
    n = F.col("_n")
    picked = exact_ranks(samples, keys, seconds, {
        "_low": F.floor((n + 1) / 2), "_high": F.floor(n / 2) + 1,
        "p95": F.greatest(F.lit(1), F.ceil(F.lit(0.95) * n))})
    return picked.select(*keys, "n", ((F.col("_low") + F.col("_high")) / 2).alias("median"), "p95")


def token_means(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean prompt, completion and reasoning tokens per stage."""
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("prompt_tokens").alias("mean_prompt"),
        F.avg("completion_tokens").alias("mean_completion"),
        F.avg(F.coalesce("reasoning_tokens", F.lit(0))).alias("mean_reasoning"))


def stage_cost(means: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of one call from mean tokens; NULL and unpriced when a price is missing."""
    joined = means.join(prices, "model", "left")
    cost = (F.col("mean_prompt") * F.col("input_per_mtok")
            + F.col("mean_completion") * F.col("output_per_mtok")) / 1_000_000
    return (joined.withColumn("cost", cost).withColumn("priced", F.col("cost").isNotNull())
            .drop("input_per_mtok", "output_per_mtok"))


def end_to_end_cost(costs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum over stages, NULL when any stage is unpriced."""
    return costs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("stages"),
        F.when(F.count("cost") == F.count(F.lit(1)), F.sum("cost")).alias("cost"))


def combination_cost(pairs: DataFrame, costs: DataFrame) -> DataFrame:
    """Triage cost plus draft cost per model pair, from (stage, model, cost) rows."""
    triage = costs.filter(F.col("stage") == "triage").select(
        F.col("model").alias("triage_model"), F.col("cost").alias("triage_cost"))
    draft = costs.filter(F.col("stage") == "draft").select(
        F.col("model").alias("draft_model"), F.col("cost").alias("draft_cost"))
    return (pairs.join(triage, "triage_model", "left").join(draft, "draft_model", "left")
            .withColumn("cost", F.col("triage_cost") + F.col("draft_cost")))


def usage_rollup(traces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Calls, attempts, tokens, seconds, log-probability share, retries and methods used."""
    return traces.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("attempts").alias("attempts"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.coalesce("reasoning_tokens", F.lit(0))).alias("reasoning_tokens"),
        F.sum("seconds").alias("seconds"), F.sum("extra_calls").alias("extra_calls"),
        F.count_if("has_logprobs").alias("with_logprobs"),
        F.count_if("degraded").alias("degraded_retries"),
        F.array_sort(F.collect_set("confidence_method")).alias("methods"),
    ).withColumn("continuous_rate", F.coalesce(
        F.try_divide(F.col("with_logprobs").cast("double"), F.col("calls")), F.lit(0.0)))


def merge_usage(parts: Sequence[DataFrame], keys: Sequence[str],
                counters: Sequence[str] = ("calls", "with_logprobs", "prompt_tokens",
                                           "completion_tokens", "reasoning_tokens",
                                           "degraded_retries")) -> DataFrame:
    """Add partial usage of resumed runs; the rate is taken from the sums, not averaged."""
    merged = parts[0].select(*keys, *counters)
    for p in parts[1:]:
        merged = merged.unionByName(p.select(*keys, *counters))
    summed = merged.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])
    return summed.withColumn("continuous_rate", F.coalesce(
        F.try_divide(F.col("with_logprobs").cast("double"), F.col("calls")), F.lit(0.0)))
