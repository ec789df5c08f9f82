"""Rater agreement, repeated labelling and acceptance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.banding import rater_band
from ..functions.columns import lits
from .classify import confusion_matrix, label_margins


def agreement(pairs: DataFrame, keys: Sequence[str] = (), bands: int = 4,
              a: str = "human_band", b: str = "judge_band", errors: bool = False) -> DataFrame:
    """Quadratic-weighted kappa, Spearman, exact and within-one rates and n.

    With ``errors`` a column of that name counts the pairs left out because a side has no
    band, and a key whose every pair is left out keeps its row, without metrics.

    Rows are counted per band pair, combined map-side; ranks for Spearman come
    from the cumulative band counts, so no sort and no window.
    Kappa is NULL when chance agreement is total, Spearman when n <= 2 or one
    side has no variance. Every metric of an empty set is absent, not zero.
    """
    side = range(bands)
    joint = (pairs.groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b"))
             .agg(F.count(F.lit(1)).alias("_k")))
    # At most (bands + 1)² rows per key from here on; unbanded rows fall out of the
    # sums (a filter would be pushed down and repeat the banding per row). The counts
    # travel as one array: a wide projection makes constraint inference very slow.
    staged = joint.groupBy(*keys).agg(F.array(*[
        F.sum(F.when((F.col("_a") == i) & (F.col("_b") == j), F.col("_k")).otherwise(0))
        .cast("double") for i in side for j in side]).alias("_o"), F.sum("_k").alias("_all"))

    def total(terms) -> str:
        return " + ".join(terms)

    def rank(counts: str) -> str:
        """Average rank of each band minus the mean rank."""
        return (f"transform({counts}, (k, i) -> aggregate(slice({counts}, 1, i), 0D, "
                "(s, v) -> s + v) + (k + 1) / 2 - (_n + 1) / 2)")

    cells = [(i, j, f"_o[{i * bands + j}]") for i in side for j in side]
    apart = [(i, j, o, (i - j) ** 2) for i, j, o in cells if i != j]
    by_row = ", ".join(total(o for i, _, o in cells if i == k) for k in side)
    by_col = ", ".join(total(o for _, j, o in cells if j == k) for k in side)
    staged = staged.selectExpr(*keys, "_o", f"array({by_row}) AS _r", f"array({by_col}) AS _c",
                               "aggregate(_o, 0D, (s, v) -> s + v) AS _n", "_all")
    staged = staged.selectExpr(*keys, "_o", "_r", "_c", "_n", f"{rank('_r')} AS _x",
                               f"{rank('_c')} AS _y", "_all")
    seen = total(f"{o} * {w}" for _, _, o, w in apart)
    chance = total(f"_r[{i}] * _c[{j}] * {w}" for i, j, _, w in apart)
    cov = total(f"{o} * _x[{i}] * _y[{j}]" for i, j, o in cells)
    spread_x = total(f"_r[{i}] * _x[{i}] * _x[{i}]" for i in side)
    spread_y = total(f"_c[{i}] * _y[{i}] * _y[{i}]" for i in side)
    exact = total(o for i, j, o in cells if i == j)
    near = total(o for i, j, o in cells if abs(i - j) <= 1)
    left_out = ["_all - CAST(_n AS BIGINT) AS errors"] if errors else []
    found = staged.selectExpr(
        *keys, "CAST(_n AS BIGINT) AS n", *left_out,
        f"1 - try_divide({seen}, try_divide({chance}, _n)) AS kappa",
        f"CASE WHEN _n > 2 THEN try_divide({cov}, sqrt(({spread_x}) * ({spread_y}))) END AS spearman",
        f"try_divide({exact}, _n) AS exact",
        f"try_divide({near}, _n) AS within_one")
    return found.filter((F.col("n") > 0) | (F.col("errors") > 0) if errors else F.col("n") > 0)


def band_scores(scores: DataFrame, score: str = "score", metric: str = "metric",
                out: str = "judge_band") -> DataFrame:
    """Band of each 0-1 rater score; scores off the scale become NULL."""
    return scores.withColumn(out, rater_band(F.col(score), F.col(metric)))


def off_scale(scores: DataFrame, score: str = "score", metric: str = "metric") -> DataFrame:
    """Scores that fall in no band, or name an unknown metric."""
    return scores.filter(rater_band(F.col(score), F.col(metric)).isNull())


def match_raters(human: DataFrame, judged: DataFrame,
                 keys: Sequence[str] = ("record_id", "metric")) -> DataFrame:
    """Human labels with rater scores on a composite key; both sides must have a value."""
    return human.join(judged.filter(F.col("score").isNotNull()), list(keys))


def missing_ratings(human: DataFrame, judged: DataFrame,
                    keys: Sequence[str] = ("record_id", "metric")) -> DataFrame:
    """Human labels without a usable rater score; any row here blocks agreement."""
    return human.join(judged.filter(F.col("score").isNotNull()), list(keys), "left_anti")


def cohen_kappa(pairs: DataFrame, labels: Sequence[str], keys: Sequence[str] = (),
                expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """Unweighted kappa over declared labels; NULL when chance agreement is total."""
    margins = label_margins(
        confusion_matrix(pairs, labels, keys, expected, predicted), keys)
    sums = margins.groupBy(*keys).agg(
        F.sum("support").cast("double").alias("n"), F.sum("hits").cast("double").alias("hits"),
        F.sum(F.col("support").cast("double") * F.col("predicted")).alias("chance"))
    observed = F.try_divide(F.col("hits"), F.col("n"))
    chance = F.try_divide(F.col("chance"), F.col("n") * F.col("n"))
    return sums.select(*keys, F.col("n").cast("bigint").alias("n"),
                       F.try_divide(observed - chance, 1 - chance).alias("kappa"))


def spread(values: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, sample deviation, min and max over runs; no deviation at one run."""
    return values.groupBy(*keys).agg(
        F.count(value).alias("runs"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"))


def contested(opinions: DataFrame, runs: int) -> DataFrame:
    """Labels a second opinion disputed, per record and field.

    ``opinions`` has one row per (run, record) with planned_*/opinion_* columns
    and the array ``acceptable_types``. A dispute is documented when all second
    opinions on the case type are acceptable for the record.
    """
    fields = F.array(
        F.struct(F.lit("case_type").alias("field"), F.col("planned_type").alias("planned"),
                 F.col("opinion_type").alias("opinion"),
                 F.col("acceptable_types").alias("allowed")),
        F.struct(F.lit("priority").alias("field"), F.col("planned_priority").alias("planned"),
                 F.col("opinion_priority").alias("opinion"),
                 F.array().cast("array<string>").alias("allowed")))
    disputed = (opinions.select("record_id", F.inline(fields))
                .filter(F.col("opinion") != F.col("planned")))
    grouped = disputed.groupBy("record_id", "field").agg(
        F.count(F.lit(1)).alias("runs_contested"), F.first("planned").alias("planned"),
        F.array_sort(F.collect_set("opinion")).alias("second_opinions"),
        F.first("allowed").alias("_allowed"))
    documented = ((F.size("_allowed") > 0)
                  & (F.size(F.array_except("second_opinions", "_allowed")) == 0))
    always = F.col("runs_contested") == runs
    return grouped.select(
        "record_id", "field", "planned", "runs_contested", "second_opinions",
        always.alias("always"), documented.alias("documented"),
        (always & ~documented).alias("outstanding"))


def most_contested(found: DataFrame) -> DataFrame:
    """Most disputed first; equal counts by record and field."""
    return found.orderBy(F.desc("runs_contested"), "record_id", "field")


def pair_ordering(items: DataFrame, score: str = "judge_score",
                  keys: Sequence[str] = ()) -> DataFrame:
    """Per complete pair: boundary, both scores and whether upper beats lower strictly."""
    by_pair = items.groupBy(*keys, "pair_id").agg(
        F.count(F.lit(1)).alias("members"),
        F.min("target_score").alias("low_target"), F.max("target_score").alias("high_target"),
        F.min_by(score, "target_score").alias("lower_score"),
        F.max_by(score, "target_score").alias("upper_score"))
    return (by_pair.filter(F.col("members") == 2).drop("members")
            .withColumn("strictly_ordered", F.col("upper_score") > F.col("lower_score")))


def ordering_by_boundary(ordered: DataFrame, keys: Sequence[str] = (),
                         boundaries: Sequence[tuple[int, int]] = fixed.BOUNDARY_PAIRS
                         ) -> DataFrame:
    """Ordered and total pairs per declared boundary, zero-filled."""
    labels = [f"{a}/{b}" for a, b in boundaries]
    one = F.lit(1).cast("bigint")
    boundary = F.concat_ws("/", F.col("low_target").cast("string"),
                           F.col("high_target").cast("string"))
    rows = ordered.select(*keys, boundary.alias("boundary"),
                          F.when(F.col("strictly_ordered"), 1).otherwise(0).alias("hit"),
                          one.alias("one"))
    aggs = []
    for label in labels:
        here = F.col("boundary") == label
        aggs += [F.sum(F.when(here, F.col("hit")).otherwise(0)).alias(f"o|{label}"),
                 F.sum(F.when(here, F.col("one")).otherwise(0)).alias(f"t|{label}")]
    wide = rows.groupBy(*keys).agg(*aggs)
    cells = F.array(*[
        F.struct(F.lit(b).alias("boundary"), F.coalesce(F.col(f"`o|{b}`"), F.lit(0)).alias("ordered"),
                 F.coalesce(F.col(f"`t|{b}`"), F.lit(0)).alias("total")) for b in labels])
    return wide.select(*keys, F.inline(cells))


def unseal(blind: DataFrame, key: DataFrame) -> DataFrame:
    """Blind scores with the private key's expected values."""
    return key.join(blind, "blind_id")


def judge_acceptance(measures: DataFrame, criteria: DataFrame,
                     keys: Sequence[str] = ()) -> DataFrame:
    """Every criterion of every profile against long measures; a missing measure fails.

    ``measures`` is (keys, measure, value); ``criteria`` is (profile, criterion,
    measure, op, threshold), a handful of rows.
    """
    table = measures.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("measure", "value"))).alias("_m"))
    rules = F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(
            ("profile", "criterion", "measure", "op", "threshold"), row)]) for row in criteria])
    value = F.try_element_at("_m", F.col("measure"))
    met = F.when(F.col("op") == ">=", value >= F.col("threshold")).otherwise(
        value == F.col("threshold"))
    return (table.select(*keys, "_m", F.inline(rules))
            .select(*keys, "profile", "criterion", value.alias("value"), "threshold",
                    F.coalesce(met, F.lit(False)).alias("met")))


def acceptance_verdict(judged: DataFrame, keys: Sequence[str] = (), names: bool = False) -> DataFrame:
    """Profile passes when every criterion is met; ``names`` adds ``unmet``, the criteria missed."""
    unmet = F.array_join(F.array_sort(F.collect_list(
        F.when(~F.col("met"), F.col("criterion")))), "|").alias("unmet")
    return judged.groupBy(*keys, "profile").agg(
        F.bool_and("met").alias("passed"), F.count(F.lit(1)).alias("criteria"),
        F.count_if(~F.col("met")).alias("failed"), *([unmet] if names else []))


def validation_measures(items: DataFrame, keys: Sequence[str],
                        boundaries: Sequence[tuple[int, int]] = fixed.BOUNDARY_PAIRS,
                        pairs_wanted: int = 3, pairs_ordered: int = 2) -> DataFrame:
    """Long (keys, measure, value) summary of a scored validation set.

    ``items`` carries pair_id, target_score, metric, expected_band, judge_score,
    blind_score (0-1 scale), error, has_logprobs and degraded per variant. A row with an error is a
    failure and enters neither agreement nor ordering.
    """
    good = items.filter(F.col("error").isNull())
    # Both raters side by side as rows: one pass for agreement, one for ordering.
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_score").alias("score"))
                      for s in ("judge", "blind")])
    rated = good.select(*keys, "pair_id", "target_score", "metric", "expected_band",
                        F.inline(sides))
    rated = rated.withColumn("band", rater_band(F.col("score"), F.col("metric")))
    by_side = [*keys, "side"]
    agreed = agreement(rated, by_side, a="expected_band", b="band")
    per_boundary = ordering_by_boundary(pair_ordering(rated, "score", by_side), by_side, boundaries)
    ordered = per_boundary.groupBy(*by_side).agg(F.min(F.when(
        (F.col("total") == pairs_wanted) & (F.col("ordered") >= pairs_ordered), 1.0)
        .otherwise(0.0)).alias("value"))
    parts = [
        agreed.select(*by_side, F.inline(F.array(*[
            F.struct(F.lit(m).alias("name"), F.col(m).cast("double").alias("value"))
            for m in ("kappa", "spearman", "exact", "within_one")]))),
        ordered.select(*by_side, F.lit("pairs_ok").alias("name"), "value")]
    parts = [p.select(*keys, F.concat_ws("_", "side", "name").alias("measure"), "value")
             for p in parts]
    usage = items.groupBy(*keys).agg(
        F.count_if(F.col("error").isNull()).alias("items"),
        F.count_if(F.col("error").isNotNull()).alias("failures"),
        F.count_if(F.col("degraded")).alias("degraded_retries"),
        F.count_if(F.col("has_logprobs")).alias("with_logprobs"))
    parts.append(usage.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"))
        for m in ("items", "failures", "degraded_retries", "with_logprobs")]))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def label_template(records: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One empty label row per record and metric."""
    return records.select("record_id", F.explode(lits(metrics)).alias("metric"),
                          F.lit(None).cast("int").alias("human"))
