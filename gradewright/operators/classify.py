"""Joining labels with outputs, and classification quality."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.columns import fill_grid, lits, ratio


def join_records(enquiries: DataFrame, golden: DataFrame, key: str = "record_id") -> DataFrame:
    """Enquiry with its label, one row per shared id."""
    return enquiries.join(golden, key)


def bind_outputs(records: DataFrame, outputs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every record with what was produced for it; a missing output stays a visible row."""
    marked = outputs.withColumn("_made", F.lit(True))
    return (records.join(marked, list(keys), "left")
            .withColumn("produced_output", F.col("_made").isNotNull()).drop("_made"))


def confusion_matrix(pairs: DataFrame, labels: Sequence, keys: Sequence[str] = (),
                     expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """Counts per (expected, predicted) over a declared label list, zero cells kept."""
    known = pairs.filter(F.col(expected).isin(*labels) & F.col(predicted).isin(*labels))
    counts = (known.groupBy(*keys, F.col(expected).alias("expected"),
                            F.col(predicted).alias("predicted"))
              .agg(F.count(F.lit(1)).alias("n")))
    return fill_grid(counts, keys, {"expected": labels, "predicted": labels}, "n")


def unknown_labels(pairs: DataFrame, labels: Sequence, keys: Sequence[str] = (),
                   expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """Pairs that use a label outside the declared list, counted instead of vanishing."""
    def outside(c: str) -> Column:
        return F.coalesce(~F.col(c).isin(*labels), F.lit(True))
    return (pairs.filter(outside(expected) | outside(predicted))
            .groupBy(*keys, F.col(expected).alias("expected"),
                     F.col(predicted).alias("predicted"))
            .agg(F.count(F.lit(1)).alias("n")))


def label_margins(matrix: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Row total, column total and diagonal per label, from a long matrix."""
    on_diagonal = F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("expected").alias("label"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"), on_diagonal.alias("hits")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
    )
    return (matrix.select(*keys, F.inline(sides))
            .groupBy(*keys, "label")
            .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
                 F.sum("hits").alias("hits")))


def label_report(matrix: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Support, precision, recall and F1 per label (0 when undefined), plus accuracy."""
    rows = label_margins(matrix, keys)
    zero = F.lit(0.0)
    rows = (rows
            .withColumn("precision", F.coalesce(ratio(F.col("hits"), F.col("predicted")), zero))
            .withColumn("recall", F.coalesce(ratio(F.col("hits"), F.col("support")), zero))
            .withColumn("f1", F.coalesce(ratio(
                2 * F.col("precision") * F.col("recall"),
                F.col("precision") + F.col("recall")), zero)))
    # One partition per key over a handful of label rows, never over records.
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return rows.withColumn("accuracy", F.coalesce(
        ratio(F.sum("hits").over(group), F.sum("support").over(group)), zero))


def macro_f1(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean F1 over the labels that have support; NULL when none has."""
    return report.groupBy(*keys).agg(
        F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1"))


def _hit(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def accuracy_gap(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Strict and lenient accuracy and the gap; lenient also takes acceptable labels."""
    exact = F.col("predicted_type") == F.col("expected_type")
    listed = F.coalesce(F.array_contains("acceptable_types", F.col("predicted_type")),
                        F.lit(False))
    out = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("scored"),
        F.avg(_hit(exact)).alias("strict"),
        F.avg(_hit(exact | listed)).alias("lenient"))
    return out.withColumn("gap", F.col("lenient") - F.col("strict"))


def priority_scores(scored: DataFrame, keys: Sequence[str] = (),
                    critical: str = "URGENT") -> DataFrame:
    """Priority accuracy and recall of the critical label; NULL recall without support."""
    right = _hit(F.col("predicted_priority") == F.col("expected_priority"))
    is_critical = F.col("expected_priority") == critical
    return scored.groupBy(*keys).agg(
        F.avg(right).alias("priority_accuracy"),
        F.sum(_hit(is_critical)).cast("bigint").alias("critical_support"),
        F.avg(F.when(is_critical, right)).alias("critical_recall"))


def headline_scores(scored: DataFrame, keys: Sequence[str], critical: str = "URGENT") -> DataFrame:
    """Case-type accuracy, priority accuracy and critical recall as long rows, in one pass."""
    right = _hit(F.col("predicted_priority") == F.col("expected_priority"))
    wide = scored.groupBy(*keys).agg(
        F.avg(_hit(F.col("predicted_type") == F.col("expected_type"))).alias("case type accuracy"),
        F.avg(right).alias("priority accuracy"),
        F.avg(F.when(F.col("expected_priority") == critical, right)).alias("urgent recall"))
    return wide.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
        for m in ("case type accuracy", "priority accuracy", "urgent recall")])))


def metric_means(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unpooled mean of per-record scores over the rows marked ``scored``."""
    counted = F.col("status") == "scored"
    return scores.groupBy(*keys).agg(
        F.avg(F.when(counted, F.col("score"))).alias("value"),
        F.count_if(counted).alias("applicable"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "no_output").alias("no_output"))


def canonical_name(metric: Column, suffix: str = fixed.RATER_SUFFIX) -> Column:
    """Metric name without the rater library's suffix."""
    return F.when(metric.endswith(suffix),
                  F.substring(metric, F.lit(1), F.length(metric) - len(suffix))).otherwise(metric)


def route_metrics(cases: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Case x metric rows with status scored / skipped / no_output.

    Refusal records skip the draft-quality metrics; a case without output has no
    score in any metric. Runs before any expensive metric, so its filter is free.
    """
    name = canonical_name(F.col("metric"))
    refused = (F.array_contains("tags", "REFUSAL")
               & name.isin(*fixed.SKIPPED_WHEN_REFUSING))
    return (cases.withColumn("metric", F.explode(lits(metrics)))
            .withColumn("status", F.when(refused, "skipped")
                        .when(~F.col("produced_output"), "no_output").otherwise("scored"))
            .withColumn("metric", name))


@dataclass(frozen=True)
class Metric:
    """A named score over bound cases; rows outside ``applies`` are skipped, never zero.

    Called with cases alone, it gives their rows (key columns, metric, score, reason, status).
    """
    name: str
    score: Column
    reason: Column | None = None
    applies: Column | None = None
    keys: tuple[str, ...] = ("record_id",)

    def status(self) -> Column:
        made = F.when(~F.col("produced_output"), "no_output").otherwise("scored")
        if self.applies is None:
            return made
        return F.when(~F.coalesce(self.applies, F.lit(False)), "skipped").otherwise(made)

    def __call__(self, cases: DataFrame) -> DataFrame:
        return run_metrics(cases, [self])


def column_metric(name: str, score: Column, reason: Column | None = None,
                  applies: Column | None = None, keys: Sequence[str] = ("record_id",)) -> Metric:
    """Metric from Column expressions."""
    return Metric(name, score, reason, applies, tuple(keys))


def batch_metric(name: str, function: Callable, inputs: Sequence[str],
                 keys: Sequence[str] = ("record_id",)) -> Metric:
    """Metric from a user's vectorised function over pandas Series (Arrow batches)."""
    import pandas as pd

    def _call(*series: pd.Series) -> pd.Series:
        return function(*series)

    _call.__annotations__ = {"series": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(_call, "double")
    return column_metric(name, udf(*[F.col(c) for c in inputs]), keys=keys)


def run_metrics(cases: DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """All metrics over the same cases in one pass: a row per case and metric."""
    if len({m.keys for m in metrics}) != 1:
        raise ValueError("metrics that run together need the same key columns")
    keys = metrics[0].keys
    # Scores first, each in a column: vectorised functions are not evaluated inside a generator.
    scored = cases.select(*keys, *[c for i, m in enumerate(metrics) for c in (
        m.status().alias(f"_status{i}"), m.score.cast("double").alias(f"_score{i}"),
        (m.reason if m.reason is not None else F.lit("")).alias(f"_reason{i}"))])
    rows = []
    for i, m in enumerate(metrics):
        open_ = F.col(f"_status{i}") == "scored"
        rows.append(F.struct(F.lit(m.name).alias("metric"), F.when(open_, F.col(f"_score{i}")).alias("score"),
                             F.when(open_, F.col(f"_reason{i}")).alias("reason"),
                             F.col(f"_status{i}").alias("status")))
    return scored.select(*keys, F.inline(F.array(*rows)))


def with_threshold(scores: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Add ``success``: score reaches its metric's threshold; NULL when not scored."""
    table = F.create_map(*[x for m, t in thresholds.items() for x in (F.lit(m), F.lit(t))])
    return scores.withColumn("success", F.col("score") >= F.try_element_at(table, F.col("metric")))
