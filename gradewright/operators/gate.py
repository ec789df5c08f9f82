"""Score tables per model combination: bars, fitness, resume state and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.columns import lits

CELL = ("combination",)


def _pairs(values: Mapping[str, float]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(float(v)).alias("bar"))
                     for k, v in values.items()])


def duplicate_scores(scores: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Metrics that a cell has more than one score for: (keys, metric, n)."""
    return (scores.groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def score_map(scores: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """One row per cell with a metric -> value map (bounded by the metric list).

    Of repeated scores (see ``duplicate_scores``) the lowest measured one counts, so a
    repetition never lifts a cell over a bar.
    """
    single = scores.groupBy(*keys, "metric").agg(F.min("value").alias("value"))
    return single.groupBy(*keys).agg(F.map_from_entries(
        F.collect_list(F.struct("metric", "value"))).alias("_scores"))


def cell_verdicts(cells: DataFrame, measured: Mapping[str, Column], rate: Column,
                  keys: Sequence[str], draft: Mapping[str, float] = fixed.DRAFT_WEIGHTS["recorded"],
                  triage: Mapping[str, float] = fixed.TRIAGE_WEIGHTS,
                  bars: Mapping[str, float] = fixed.HARD_BARS,
                  max_rate: float = fixed.MAX_FAILURE_RATE,
                  share: Mapping[str, float] = fixed.STAGE_SHARE) -> DataFrame:
    """Gate over one wide row per cell: everything after the metrics is row-level.

    ``measured`` maps metric names to columns; NULL is not measured, which misses no bar
    but leaves the composites that need it NULL. ``missed`` names the missed bars and the
    failure rate over its cap, sorted.
    """
    names = F.array(*[F.when(measured[m] < F.lit(float(b)), F.lit(m)) for m, b in bars.items()
                      if m in measured],
                    F.when(rate > F.lit(float(max_rate)), F.lit("schema failure rate")))

    def weighted(weights: Mapping[str, float]) -> Column:
        total = F.lit(0.0)
        for metric, weight in weights.items():
            total = total + measured.get(metric, F.lit(None).cast("double")) * F.lit(weight)
        return total

    row = cells.select(*keys, weighted(triage).alias("triage"), weighted(draft).alias("draft"),
                       rate.alias("schema_failure_rate"), F.array_sort(F.array_compact(names)).alias("missed"))
    row = row.withColumn("breaches", F.size("missed").cast("bigint")).withColumn(
        "diagnostic", F.col("triage") * share["triage"] + F.col("draft") * share["draft"])
    return (row.withColumn("published", F.when(F.col("breaches") == 0, F.col("diagnostic")))
            .withColumn("verdict", F.when(F.col("breaches") == 0, "PASS").otherwise("DISQUALIFIED")))


def breaches(scores: DataFrame, rates: DataFrame, keys: Sequence[str] = CELL,
             bars: Mapping[str, float] = fixed.HARD_BARS,
             max_rate: float = fixed.MAX_FAILURE_RATE) -> DataFrame:
    """Missed bars per cell. Only measured metrics can be missed; the failure rate has a cap."""
    bar = F.try_element_at(F.map_from_entries(_pairs(bars)), F.col("metric"))
    missed = (scores.withColumn("bar", bar).filter(F.col("value") < F.col("bar"))
              .select(*keys, "metric", "value", "bar"))
    over = rates.filter(F.col("schema_failure_rate") > max_rate).select(
        *keys, F.lit("schema failure rate").alias("metric"),
        F.col("schema_failure_rate").alias("value"), F.lit(float(max_rate)).alias("bar"))
    return missed.unionByName(over)


def _weighted(weights: Mapping[str, float]) -> Column:
    """Weighted sum over the score map; NULL as soon as one metric is unmeasured."""
    total = None
    for metric, weight in weights.items():
        term = F.try_element_at("_scores", F.lit(metric)) * F.lit(weight)
        total = term if total is None else total + term
    return total


def fitness(scores: DataFrame, breached: DataFrame, keys: Sequence[str] = CELL,
            profiles: Mapping[str, Mapping[str, float]] = fixed.DRAFT_WEIGHTS,
            triage: Mapping[str, float] = fixed.TRIAGE_WEIGHTS,
            share: Mapping[str, float] = fixed.STAGE_SHARE) -> DataFrame:
    """Stage composites and the diagnostic score per cell and weight profile.

    ``published`` is withheld (NULL) when any bar is missed; the diagnostic
    number never qualifies a cell.
    """
    per_cell = score_map(scores, keys)
    missed = breached.groupBy(*keys).agg(F.count(F.lit(1)).alias("breaches"))
    rows = None
    for profile, weights in profiles.items():
        part = per_cell.select(
            *keys, F.lit(profile).alias("profile"), _weighted(triage).alias("triage"),
            _weighted(weights).alias("draft"))
        rows = part if rows is None else rows.unionByName(part)
    out = rows.join(missed, list(keys), "left").withColumn(
        "breaches", F.coalesce("breaches", F.lit(0)))
    overall = F.col("triage") * share["triage"] + F.col("draft") * share["draft"]
    out = out.withColumn("diagnostic", overall)
    return (out.withColumn("published", F.when(F.col("breaches") == 0, F.col("diagnostic")))
            .withColumn("verdict", F.when(F.col("breaches") == 0, "PASS")
                        .otherwise("DISQUALIFIED")))


def score_matrix(scores: DataFrame, metrics: Sequence[str],
                 keys: Sequence[str] = CELL) -> DataFrame:
    """Cell x metric table plus the names that were not measured; never a zero."""
    per_cell = score_map(scores, keys)
    unmeasured = F.array_sort(F.filter(
        F.map_keys("_scores"), lambda m: F.try_element_at("_scores", m).isNull()))
    return per_cell.select(
        *keys, *[F.try_element_at("_scores", F.lit(m)).alias(m.replace(" ", "_"))
                 for m in metrics], unmeasured.alias("not_measured"))


def model_pairs(models: DataFrame) -> DataFrame:
    """Every (triage model, draft model) combination of a model list.

    The list is configuration: one row of distinct names is exploded twice.
    """
    names = models.groupBy().agg(F.collect_set("model").alias("_m"))
    return names.select(F.explode("_m").alias("triage_model"), "_m").select(
        "triage_model", F.explode("_m").alias("draft_model"))


def rater_tasks(outputs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Metric x non-refusal output, with the text each metric reads."""
    kept = outputs.filter(~F.array_contains("tags", "REFUSAL"))
    target = F.when(F.col("metric") == "summary quality", F.col("summary")).otherwise(
        F.col("draft_reply"))
    return kept.withColumn("metric", F.explode(lits(metrics))).withColumn("target", target)


def variant_deltas(scores: DataFrame, keys: Sequence[str], baseline: str = "baseline",
                   candidate: str = "evidence_backed") -> DataFrame:
    """Candidate minus baseline per key; NULL when either side is missing."""
    def side(name: str) -> Column:
        return F.max(F.when(F.col("variant") == name, F.col("score")))
    return (scores.groupBy(*keys).agg(side(baseline).alias("baseline"),
                                      side(candidate).alias("candidate"))
            .withColumn("delta", F.col("candidate") - F.col("baseline")))


def paired_status(cases: DataFrame, results: DataFrame, reviews: DataFrame,
                  variants: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Per-case scaffold state and the run's status.

    A case is complete when every variant is; the run awaits review until every
    preference is set.
    """
    scaffold = cases.select("record_id", F.explode(lits(variants)).alias("variant"))
    filled = scaffold.join(results, ["record_id", "variant"], "left")
    per_case = filled.groupBy("record_id").agg(
        F.bool_and(F.coalesce(F.col("status") == "complete", F.lit(False))).alias("complete"))
    per_case = (per_case.join(reviews, "record_id", "left")
                .withColumn("reviewed", F.col("preferred").isNotNull())
                .select("record_id", "complete", "reviewed"))
    totals = per_case.groupBy().agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("complete").alias("complete"),
        F.count_if("reviewed").alias("reviewed"))
    status = F.when(F.col("complete") < F.col("cases"), "partial").when(
        F.col("reviewed") < F.col("cases"), "awaiting_human_review").otherwise("complete")
    return per_case, totals.withColumn("status", status)


def complete_cells(counts: DataFrame, records: int | Column, judged: int | Column,
                   metrics: Sequence[str], keys: Sequence[str] = CELL) -> DataFrame:
    """Cells that may be reused: all records scored, all ratings present, no errors.

    ``counts`` is long (cell, kind, name, n) with kind scored / rated / error.
    """
    records = records if isinstance(records, Column) else F.lit(records)
    judged = judged if isinstance(judged, Column) else F.lit(judged)
    kind, n = F.col("kind"), F.col("n")
    aggs = [F.sum(F.when(kind == "scored", n).otherwise(0)).alias("_scored"),
            F.sum(F.when(kind == "error", n).otherwise(0)).alias("_errors")]
    aggs += [F.sum(F.when((kind == "rated") & (F.col("name") == m), n).otherwise(0)).alias(f"_r{i}")
             for i, m in enumerate(metrics)]
    done = (F.col("_scored") == records) & (F.col("_errors") == 0)
    for i in range(len(metrics)):
        done = done & (F.col(f"_r{i}") == judged)
    return counts.groupBy(*keys).agg(*aggs).filter(done).select(*keys)


def cells_to_run(wanted: DataFrame, done: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Wanted cells without a complete result."""
    return wanted.join(done, list(keys), "left_anti")


def resume_conflicts(stored: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Settings of a stored result that differ from this run; any row refuses the resume."""
    expected = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])
    asked = F.try_element_at(expected, F.col("setting"))
    return stored.filter(asked.isNotNull() & ~F.col("value").eqNullSafe(asked)).select(
        F.col("setting").alias("key"), F.lit("resume conflict").alias("rule"),
        F.concat_ws(" -> ", "value", asked).alias("detail"))


def reconcile_published(recorded: DataFrame, published: DataFrame, keys: Sequence[str],
                        tolerance: float = 0.0005) -> DataFrame:
    """Recorded against published values: matches, differs, or on one side only."""
    a, b = F.col("recorded"), F.col("published")
    joined = recorded.join(published, list(keys), "full_outer")
    status = (F.when(a.isNull(), "not recorded").when(b.isNull(), "not published")
              .when(F.abs(a - b) < tolerance, "matches").otherwise("differs"))
    return joined.select(*keys, "recorded", "published", status.alias("status"))


def result_invariants(cells: DataFrame, tolerance: float = 1e-9,
                      keys: Sequence[str] = CELL) -> DataFrame:
    """scored + no-output = total, bucket counts sum to n, stored composite = recomputed."""
    off = F.abs(F.col("stored") - F.col("recomputed")) > tolerance
    rules = F.filter(F.array(
        F.when(F.col("scored") + F.col("no_output") != F.col("total"), "rows lost"),
        F.when(F.col("bucket_total") != F.col("scored"), "bucket counts"),
        F.when(F.coalesce(off, F.col("stored").isNull() != F.col("recomputed").isNull()),
               "composite differs")), lambda x: x.isNotNull())
    return cells.select(*keys, F.explode(rules).alias("rule"))


def add_running_sums(state: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge partial sums: (keys, n, total) tables add up in any order."""
    return (state.unionByName(batch).groupBy(*keys)
            .agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
