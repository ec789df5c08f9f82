"""Queries: classification quality, calibration and rater agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions.banding import band_of
from ..operators import agree, calibrate, classify
from .registry import Tables, query

CELL = ["triage_model", "draft_model"]
R9 = 9


def r9(df, *names):
    """Round metric columns so summation order cannot show."""
    return df.withColumns({n: F.round(n, R9) for n in names})


def split_list(name: str):
    """Comma list to array without empty entries."""
    return F.filter(F.split(name, ","), lambda x: x != "")


def gold(t: Tables):
    return (t.view("gold").withColumn("acceptable_types", split_list("acceptable"))
            .withColumn("tags", split_list("tag_list")))


def scored(t: Tables):
    """Labels with the outputs that exist, one row per record and cell."""
    outputs = t.view("outputs").withColumnsRenamed(
        {"case_type": "predicted_type", "priority": "predicted_priority"}).drop("doc_id")
    return classify.join_records(outputs, gold(t))


def type_pairs(t: Tables):
    return scored(t).select(*CELL, F.col("expected_type").alias("expected"),
                            F.col("predicted_type").alias("predicted"))


_LABELS = ", ".join(f"('{c}')" for c in fixed.CASE_TYPES)
SCORED_CTE = """scored AS (
  SELECT o.triage_model, o.draft_model, o.record_id, g.expected_type, g.expected_priority,
         g.acceptable, g.tag_list, o.case_type AS predicted_type, o.priority AS predicted_priority,
         o.confidence
  FROM outputs o JOIN gold g ON o.record_id = g.record_id)"""
_MATRIX_CTE = f"""labels_list(label) AS (VALUES {_LABELS}),
{SCORED_CTE},
keys AS (SELECT DISTINCT triage_model, draft_model FROM scored),
matrix AS (
  SELECT k.triage_model, k.draft_model, e.label AS expected, p.label AS predicted,
         count(s.record_id) AS n
  FROM keys k CROSS JOIN labels_list e CROSS JOIN labels_list p
  LEFT JOIN scored s ON s.triage_model = k.triage_model AND s.draft_model = k.draft_model
       AND s.expected_type = e.label AND s.predicted_type = p.label
  GROUP BY 1, 2, 3, 4)"""
_REPORT_CTE = _MATRIX_CTE + """,
sup AS (SELECT triage_model, draft_model, expected AS label, sum(n) AS support,
               sum(CASE WHEN expected = predicted THEN n ELSE 0 END) AS hits
        FROM matrix GROUP BY 1, 2, 3),
pre AS (SELECT triage_model, draft_model, predicted AS label, sum(n) AS predicted
        FROM matrix GROUP BY 1, 2, 3),
pr AS (SELECT s.*, p.predicted, coalesce(hits / nullif(p.predicted, 0), 0) AS precision_,
              coalesce(hits / nullif(support, 0), 0) AS recall_
       FROM sup s JOIN pre p USING (triage_model, draft_model, label)),
report AS (SELECT *, CASE WHEN precision_ + recall_ = 0 THEN 0
                          ELSE 2 * precision_ * recall_ / (precision_ + recall_) END AS f1
           FROM pr)"""


@query("j1_record_join", f"""
    SELECT g.record_id, g.expected_type, g.expected_priority, d.lang, d.n_chars
    FROM documents d JOIN gold g ON d.doc_id = g.doc_id""")
def _(t):
    return classify.join_records(
        t.base("documents").select("doc_id", "lang", "n_chars"),
        gold(t).select("doc_id", "record_id", "expected_type", "expected_priority"),
        "doc_id").drop("doc_id")


@query("j2_bind_outputs", """
    SELECT g.record_id, g.expected_type, o.case_type AS predicted_type, o.confidence,
           o.record_id IS NOT NULL AS produced_output
    FROM gold g LEFT JOIN (SELECT * FROM outputs WHERE triage_model = 'swift-1'
                                                   AND draft_model = 'deep-1') o
      ON g.record_id = o.record_id""")
def _(t):
    cell = t.view("outputs").filter(
        (F.col("triage_model") == "swift-1") & (F.col("draft_model") == "deep-1"))
    bound = classify.bind_outputs(
        gold(t).select("record_id", "expected_type"),
        cell.select("record_id", F.col("case_type").alias("predicted_type"), "confidence"),
        ["record_id"])
    return bound.select("record_id", "expected_type", "predicted_type", "confidence",
                        "produced_output")


@query("a1_confusion_matrix", f"WITH {_MATRIX_CTE} SELECT * FROM matrix")
def _(t):
    return classify.confusion_matrix(type_pairs(t), fixed.CASE_TYPES, CELL)


@query("a1_unknown_labels", f"""WITH {SCORED_CTE}
    SELECT triage_model, draft_model, expected_type AS expected, predicted_type AS predicted,
           count(*) AS n
    FROM scored WHERE expected_type NOT IN ('CLAIM', 'OTHER', 'POLICY_QUERY')
                   OR predicted_type NOT IN ('CLAIM', 'OTHER', 'POLICY_QUERY')
    GROUP BY 1, 2, 3, 4""")
def _(t):
    return classify.unknown_labels(type_pairs(t), ("CLAIM", "OTHER", "POLICY_QUERY"), CELL)


@query("a2_label_report", f"""WITH {_REPORT_CTE}
    SELECT triage_model, draft_model, label, CAST(support AS BIGINT) AS support,
           CAST(predicted AS BIGINT) AS predicted, CAST(hits AS BIGINT) AS hits,
           round(precision_, 9) AS precision, round(recall_, 9) AS recall, round(f1, 9) AS f1,
           round(sum(hits) OVER w / sum(support) OVER w, 9) AS accuracy
    FROM report WINDOW w AS (PARTITION BY triage_model, draft_model)""")
def _(t):
    matrix = classify.confusion_matrix(type_pairs(t), fixed.CASE_TYPES, CELL)
    return r9(classify.label_report(matrix, CELL), "precision", "recall", "f1", "accuracy")


@query("a3_macro_f1", f"""WITH {_REPORT_CTE}
    SELECT triage_model, draft_model, round(avg(f1) FILTER (WHERE support > 0), 9) AS macro_f1
    FROM report GROUP BY 1, 2""")
def _(t):
    matrix = classify.confusion_matrix(type_pairs(t), fixed.CASE_TYPES, CELL)
    return r9(classify.macro_f1(classify.label_report(matrix, CELL), CELL), "macro_f1")


@query("a4_strict_lenient_accuracy", f"""WITH {SCORED_CTE},
    f AS (SELECT *, CASE WHEN predicted_type = expected_type THEN 1.0 ELSE 0.0 END AS s,
                 CASE WHEN predicted_type = expected_type
                        OR list_contains(string_split(acceptable, ','), predicted_type)
                      THEN 1.0 ELSE 0.0 END AS l FROM scored)
    SELECT triage_model, draft_model, count(*) AS scored, round(avg(s), 9) AS strict,
           round(avg(l), 9) AS lenient, round(avg(l) - avg(s), 9) AS gap
    FROM f GROUP BY 1, 2""")
def _(t):
    return r9(classify.accuracy_gap(scored(t), CELL), "strict", "lenient", "gap")


@query("a5_priority_scores", f"""WITH {SCORED_CTE}
    SELECT triage_model, draft_model,
           round(avg(CASE WHEN predicted_priority = expected_priority THEN 1.0 ELSE 0.0 END), 9)
             AS priority_accuracy,
           count(*) FILTER (WHERE expected_priority = 'URGENT') AS critical_support,
           round(avg(CASE WHEN predicted_priority = expected_priority THEN 1.0 ELSE 0.0 END)
             FILTER (WHERE expected_priority = 'URGENT'), 9) AS critical_recall
    FROM scored GROUP BY 1, 2""")
def _(t):
    return r9(classify.priority_scores(scored(t), CELL), "priority_accuracy", "critical_recall")


# ---- applicability, metric means, calibration ---------------------------------------
ROUTED = ("case type", "tone match [GEval]", "summary quality", "commitment groundedness")


def routed(t: Tables):
    """Labels x cells with produced flag, routed over four metrics with an integer-based score."""
    cells = F.array(*[F.struct(F.lit(a).alias("triage_model"), F.lit(b).alias("draft_model"))
                      for a in ("swift-1", "deep-1") for b in ("swift-1", "deep-1")])
    cases = gold(t).select("record_id", "doc_id", "n_chars", "tags", F.inline(cells))
    bound = classify.bind_outputs(
        cases, t.view("outputs").select("record_id", *CELL, "confidence"), ["record_id", *CELL])
    return classify.route_metrics(bound, ROUTED).withColumn(
        "score", F.when(F.col("status") == "scored", (
            (F.col("doc_id") * 11 + F.col("n_chars") + F.length("metric")) % 11) / 10))


_ROUTED_CTE = """cases AS (
  SELECT g.record_id, g.doc_id, g.n_chars, g.tag_list, c.a AS triage_model, c.b AS draft_model
  FROM gold g CROSS JOIN (SELECT a, b FROM (VALUES ('swift-1'), ('deep-1')) x(a)
                          CROSS JOIN (VALUES ('swift-1'), ('deep-1')) y(b)) c),
routed AS (
  SELECT c.record_id, c.triage_model, c.draft_model, replace(m.metric, ' [GEval]', '') AS metric,
         CASE WHEN contains(c.tag_list, 'REFUSAL,') AND m.metric <> 'case type' THEN 'skipped'
              WHEN o.record_id IS NULL THEN 'no_output' ELSE 'scored' END AS status,
         ((c.doc_id * 11 + c.n_chars + length(replace(m.metric, ' [GEval]', ''))) % 11) / 10.0::DOUBLE
           AS raw_score
  FROM cases c CROSS JOIN (VALUES ('case type'), ('tone match [GEval]'), ('summary quality'),
                                  ('commitment groundedness')) m(metric)
  LEFT JOIN outputs o ON o.record_id = c.record_id AND o.triage_model = c.triage_model
                     AND o.draft_model = c.draft_model)"""


@query("f9_metric_routing", f"""WITH {_ROUTED_CTE}
    SELECT record_id, triage_model, draft_model, metric, status FROM routed""")
def _(t):
    return routed(t).select("record_id", *CELL, "metric", "status")


@query("a6_metric_means", f"""WITH {_ROUTED_CTE}
    SELECT triage_model, draft_model, metric,
           round(avg(raw_score) FILTER (WHERE status = 'scored'), 9) AS value,
           count(*) FILTER (WHERE status = 'scored') AS applicable,
           count(*) FILTER (WHERE status = 'skipped') AS skipped,
           count(*) FILTER (WHERE status = 'no_output') AS no_output
    FROM routed GROUP BY 1, 2, 3""")
def _(t):
    return r9(classify.metric_means(routed(t), [*CELL, "metric"]), "value")


@query("d1_metric_plugins", """
    WITH b AS (SELECT g.record_id, g.expected_type, g.tag_list, o.case_type, o.confidence,
                      o.record_id IS NOT NULL AS made
               FROM gold g LEFT JOIN (SELECT * FROM outputs WHERE triage_model = 'swift-1'
                                        AND draft_model = 'swift-1') o USING (record_id)),
    m AS (
      SELECT record_id, 'case type' AS metric,
             CASE WHEN made THEN CASE WHEN case_type = expected_type THEN 1.0 ELSE 0.0 END END AS score,
             CASE WHEN made THEN 'predicted ' || case_type || ', expected ' || expected_type END AS reason,
             CASE WHEN made THEN 'scored' ELSE 'no_output' END AS status FROM b
      UNION ALL
      SELECT record_id, 'refusal confidence',
             CASE WHEN contains(tag_list, 'REFUSAL,') AND made THEN 1 - confidence END,
             CASE WHEN contains(tag_list, 'REFUSAL,') AND made THEN '' END,
             CASE WHEN NOT contains(tag_list, 'REFUSAL,') THEN 'skipped'
                  WHEN NOT made THEN 'no_output' ELSE 'scored' END FROM b
      UNION ALL
      SELECT record_id, 'half confidence', CASE WHEN made THEN confidence / 2 END,
             CASE WHEN made THEN '' END,
             CASE WHEN made THEN 'scored' ELSE 'no_output' END FROM b)
    SELECT record_id, metric, round(score, 9) AS score, reason, status,
           round(score, 9) >= CASE metric WHEN 'case type' THEN 1.0 ELSE 0.25 END AS success FROM m""")
def _(t):
    cell = t.view("outputs").filter((F.col("triage_model") == "swift-1")
                                    & (F.col("draft_model") == "swift-1"))
    cases = classify.bind_outputs(
        gold(t).select("record_id", "expected_type", "tags"),
        cell.select("record_id", "case_type", "confidence"), ["record_id"])
    metrics = [
        classify.column_metric(
            "case type", F.when(F.col("case_type") == F.col("expected_type"), 1.0).otherwise(0.0),
            F.concat(F.lit("predicted "), "case_type", F.lit(", expected "), "expected_type")),
        classify.column_metric("refusal confidence", 1 - F.col("confidence"),
                               applies=F.array_contains("tags", "REFUSAL")),
        classify.batch_metric("half confidence", lambda c: c / 2, ["confidence"]),
    ]
    scores = r9(classify.run_metrics(cases, metrics), "score")
    return classify.with_threshold(scores, {
        "case type": 1.0, "refusal confidence": 0.25, "half confidence": 0.25})


def confidence_pairs(t: Tables):
    return scored(t).filter(F.col("draft_model") == "swift-1").select(
        "triage_model", "record_id", "confidence",
        (F.col("predicted_type") == F.col("expected_type")).alias("correct"))


_PAIRS_CTE = f"""{SCORED_CTE},
pairs AS (SELECT triage_model, record_id, confidence, predicted_type = expected_type AS correct
          FROM scored WHERE draft_model = 'swift-1'),
buckets AS (
  SELECT triage_model,
         CASE WHEN confidence >= 0.5 AND confidence < 0.6 THEN 0.5
              WHEN confidence >= 0.6 AND confidence < 0.7 THEN 0.6
              WHEN confidence >= 0.7 AND confidence < 0.8 THEN 0.7
              WHEN confidence >= 0.8 AND confidence < 0.9 THEN 0.8
              WHEN confidence >= 0.9 AND confidence < 1.0001 THEN 0.9 ELSE 0.0 END::DOUBLE AS low,
         count(*) AS n, count(*) FILTER (WHERE correct) AS hits,
         avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS accuracy,
         avg(confidence) AS mean_confidence
  FROM pairs GROUP BY 1, 2),
ints AS (
  SELECT *, (accuracy + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) AS mid,
         1.96 / (1 + 1.96*1.96/n)
           * sqrt(accuracy*(1-accuracy)/n + 1.96*1.96/(4.0*n*n)) AS half
  FROM buckets)"""


@query("a9_calibration_table", f"""WITH {_PAIRS_CTE}
    SELECT triage_model, low, CAST(CASE low WHEN 0.0 THEN 0.5 WHEN 0.5 THEN 0.6 WHEN 0.6 THEN 0.7
             WHEN 0.7 THEN 0.8 WHEN 0.8 THEN 0.9 ELSE 1.0001 END AS DOUBLE) AS high, n, hits,
           round(accuracy, 9) AS accuracy, round(mean_confidence, 9) AS mean_confidence
    FROM buckets""")
def _(t):
    table = calibrate.calibration_table(confidence_pairs(t), ["triage_model"])
    return r9(table.drop("squared_error"), "accuracy", "mean_confidence")


def _required(p: str) -> str:
    inside = f"least(greatest({p}, 1e-6), 1 - 1e-6)"
    return f"CAST(ceil(1.96*1.96 * {inside} * (1 - {inside}) / (0.05*0.05)) AS BIGINT)"


@query("a10_calibration_intervals", f"""WITH {_PAIRS_CTE}
    SELECT triage_model, low, n, round(greatest(0.0, mid - half), 9) AS interval_low,
           round(least(1.0, mid + half), 9) AS interval_high,
           {_required('accuracy')} AS bucket_required_n, {_required('overall')} AS required_n
    FROM (SELECT *, sum(hits) OVER (PARTITION BY triage_model)::DOUBLE / sum(n) OVER (PARTITION BY triage_model)
            AS overall FROM ints)""")
def _(t):
    table = calibrate.calibration_table(confidence_pairs(t), ["triage_model"])
    return r9(calibrate.calibration_intervals(table, ["triage_model"]).select(
        "triage_model", "low", "n", "interval_low", "interval_high", "bucket_required_n", "required_n"),
        "interval_low", "interval_high")


@query("a10_widest_bucket", f"""WITH {_PAIRS_CTE}
    SELECT triage_model, low, n, round(w, 9) AS width FROM (
      SELECT *, least(1.0, mid + half) - greatest(0.0, mid - half) AS w,
             row_number() OVER (PARTITION BY triage_model ORDER BY
               least(1.0, mid + half) - greatest(0.0, mid - half) DESC, low) AS rn
      FROM ints) WHERE rn = 1""")
def _(t):
    table = calibrate.calibration_table(confidence_pairs(t), ["triage_model"])
    return r9(calibrate.widest_bucket(calibrate.calibration_intervals(table), ["triage_model"]),
              "width")


@query("a11_ece_brier", f"""WITH {_PAIRS_CTE},
    br AS (SELECT triage_model, avg(pow(confidence - CASE WHEN correct THEN 1 ELSE 0 END, 2)) AS brier
           FROM pairs GROUP BY 1)
    SELECT triage_model, CAST(sum(n) AS BIGINT) AS n,
           round(sum(n * abs(accuracy - mean_confidence)) / sum(n), 9) AS ece,
           round(any_value(brier), 9) AS brier
    FROM buckets JOIN br USING (triage_model) GROUP BY 1""")
def _(t):
    table = calibrate.calibration_table(confidence_pairs(t), ["triage_model"])
    return r9(calibrate.calibration_error(table, ["triage_model"]), "ece", "brier")


@query("o3_least_confident", f"""WITH {_PAIRS_CTE}
    SELECT * FROM (SELECT triage_model, record_id, confidence, correct,
             row_number() OVER (PARTITION BY triage_model ORDER BY confidence, record_id) AS rank
      FROM pairs) WHERE rank <= 3""")
def _(t):
    return calibrate.least_confident(confidence_pairs(t), ["triage_model"], 3)


# ---- rater agreement ----------------------------------------------------------------
def banded(t: Tables):
    rows = t.view("ratings").withColumn("human_band", band_of(F.col("human"), F.col("metric")))
    return agree.band_scores(rows)


_BAND = """CASE WHEN {m} IN ('tone match', 'summary quality')
  THEN CASE WHEN {s} BETWEEN 0 AND 3 THEN 0 WHEN {s} BETWEEN 4 AND 6 THEN 1
            WHEN {s} BETWEEN 7 AND 8 THEN 2 WHEN {s} BETWEEN 9 AND 10 THEN 3 END
  ELSE CASE WHEN {s} BETWEEN 0 AND 2 THEN 0 WHEN {s} BETWEEN 3 AND 5 THEN 1
            WHEN {s} BETWEEN 6 AND 8 THEN 2 WHEN {s} BETWEEN 9 AND 10 THEN 3 END END"""


def band_sql(score: str, metric: str = "metric") -> str:
    return _BAND.replace("{m}", metric).replace("{s}", score)


def rater_band_sql(score: str, metric: str = "metric") -> str:
    return band_sql(f"round_even({score} * 10, 0)", metric)


_AGREE = """SELECT {k}, count(*) AS n,
    round(1 - sum(pow(a - b, 2)) / nullif(sum(a*a) + sum(b*b) - 2.0 * sum(a) * sum(b) / count(*), 0), 9) AS kappa,
    round(CASE WHEN count(*) > 2 AND stddev_pop(ra) > 0 AND stddev_pop(rb) > 0
               THEN corr(ra, rb) END, 9) AS spearman,
    round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 9) AS exact,
    round(avg(CASE WHEN abs(a - b) <= 1 THEN 1.0 ELSE 0.0 END), 9) AS within_one
  FROM (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY a)
                  + (count(*) OVER (PARTITION BY {k}, a) - 1) / 2.0 AS ra,
               rank() OVER (PARTITION BY {k} ORDER BY b)
                  + (count(*) OVER (PARTITION BY {k}, b) - 1) / 2.0 AS rb FROM {t})
  GROUP BY {k}"""


def agree_sql(table: str, keys: str) -> str:
    return _AGREE.replace("{t}", table).replace("{k}", keys)


@query("x11_rubric_bands", f"""SELECT item_id, metric, human, score,
      {band_sql('human')} AS human_band, {rater_band_sql('score')} AS judge_band FROM ratings""")
def _(t):
    return banded(t).select("item_id", "metric", "human", "score", "human_band", "judge_band")


@query("a1_band_matrix", f"""
    WITH b AS (SELECT metric, {band_sql('human')} AS e, {rater_band_sql('score')} AS p FROM ratings)
    SELECT m.metric, x.i AS expected, y.i AS predicted, count(b.metric) AS n
    FROM (SELECT DISTINCT metric FROM b) m CROSS JOIN (VALUES (0), (1), (2), (3)) x(i)
    CROSS JOIN (VALUES (0), (1), (2), (3)) y(i)
    LEFT JOIN b ON b.metric = m.metric AND b.e = x.i AND b.p = y.i GROUP BY 1, 2, 3""")
def _(t):
    return classify.confusion_matrix(banded(t), (0, 1, 2, 3), ["metric"],
                                     "human_band", "judge_band")


@query("a12_rater_agreement", f"""
    WITH b AS (SELECT metric, {band_sql('human')} AS a, {rater_band_sql('score')} AS b FROM ratings)
    {agree_sql('b', 'metric')}""")
def _(t):
    return r9(agree.agreement(banded(t), ["metric"]), "kappa", "spearman", "exact", "within_one")


_ODD = """odd AS (
    SELECT item_id, metric, CASE WHEN run_no = 6 THEN score + 0.3E0 ELSE score END AS score FROM ratings)"""


@query("a12_off_scale", f"""WITH {_ODD}
    SELECT item_id, metric, round(score, 9) AS score FROM odd WHERE {rater_band_sql('score')} IS NULL""")
def _(t):
    return r9(agree.off_scale(t.sql(f"WITH {_ODD} SELECT * FROM odd")), "score")


_ERRORS = """errored AS (
    SELECT metric, human, CASE WHEN run_no = 6 OR metric = 'actionability' AND run_no > 2 THEN score + 1.3E0
                               ELSE score END AS score, run_no
    FROM ratings WHERE metric <> 'tone match' OR run_no = 6)"""


@query("a12_agreement_errors", f"""
    WITH {_ERRORS}, b AS (SELECT metric, {band_sql('human')} AS a, {rater_band_sql('score')} AS b FROM errored),
    good AS ({agree_sql("(SELECT * FROM b WHERE a IS NOT NULL AND b IS NOT NULL)", 'metric')}),
    total AS (SELECT metric, count(*) AS pairs FROM b GROUP BY 1)
    SELECT t.metric, coalesce(g.n, 0) AS n, t.pairs - coalesce(g.n, 0) AS errors, g.kappa, g.spearman, g.exact,
           g.within_one
    FROM total t LEFT JOIN good g ON g.metric = t.metric""")
def _(t):
    odd = t.sql(f"WITH {_ERRORS} SELECT * FROM errored")
    human = odd.withColumn("human_band", band_of(F.col("human"), F.col("metric")))
    found = agree.agreement(agree.band_scores(human), ["metric"], errors=True)
    return r9(found, "kappa", "spearman", "exact", "within_one")


@query("j7_matched_ratings", """
    SELECT h.record_id, h.metric, h.human, j.score FROM human_labels h
    JOIN judge_scores j ON h.record_id = j.record_id AND h.metric = j.metric
    WHERE j.score IS NOT NULL""")
def _(t):
    return agree.match_raters(t.view("human_labels"), t.view("judge_scores"))


@query("j7_missing_ratings", """
    SELECT h.record_id, h.metric, h.human FROM human_labels h WHERE NOT EXISTS (
      SELECT 1 FROM judge_scores j WHERE h.record_id = j.record_id AND h.metric = j.metric
                AND j.score IS NOT NULL)""")
def _(t):
    return agree.missing_ratings(t.view("human_labels"), t.view("judge_scores"))


def opinions(t: Tables):
    return t.view("opinions").withColumn("acceptable_types", split_list("acceptable"))




def kappa_sql(field: str) -> str:
    return f"""
    SELECT t.run_no, '{field}' AS field, t.n, round((t.po - c.pe) / nullif(1 - c.pe, 0), 9) AS kappa
    FROM (SELECT run_no, count(*) AS n,
                 avg(CASE WHEN planned_{field} = opinion_{field} THEN 1.0 ELSE 0.0 END) AS po
          FROM opinions GROUP BY 1) t
    JOIN (SELECT a.run_no, sum(a.n * 1.0 * b.n) / any_value(s.n * 1.0 * s.n) AS pe
          FROM (SELECT run_no, planned_{field} AS v, count(*) AS n FROM opinions GROUP BY 1, 2) a
          JOIN (SELECT run_no, opinion_{field} AS v, count(*) AS n FROM opinions GROUP BY 1, 2) b
            ON a.run_no = b.run_no AND a.v = b.v
          JOIN (SELECT run_no, count(*) AS n FROM opinions GROUP BY 1) s ON s.run_no = a.run_no
          GROUP BY 1) c ON t.run_no = c.run_no"""


def kappas(t: Tables):
    rows = opinions(t)
    parts = [agree.cohen_kappa(rows, labels, ["run_no"], f"planned_{f}", f"opinion_{f}")
             .withColumn("field", F.lit(f))
             for f, labels in (("type", fixed.CASE_TYPES), ("priority", fixed.PRIORITIES))]
    return parts[0].unionByName(parts[1])


_KAPPAS_SQL = f"{kappa_sql('type')} UNION ALL {kappa_sql('priority')}"


@query("a13_cohen_kappa", _KAPPAS_SQL)
def _(t):
    return r9(kappas(t), "kappa").select("run_no", "field", "n", "kappa")


@query("a14_kappa_spread", f"""
    WITH k AS ({_KAPPAS_SQL})
    SELECT field, count(kappa) AS runs, round(avg(kappa), 6) AS mean,
           round(stddev_samp(kappa), 6) AS sd, round(min(kappa), 6) AS low,
           round(max(kappa), 6) AS high FROM k GROUP BY 1""")
def _(t):
    return agree.spread(kappas(t), "kappa", ["field"]).withColumns(
        {c: F.round(c, 6) for c in ("mean", "sd", "low", "high")})


_CONTESTED = """
    WITH f AS (
      SELECT record_id, 'case_type' AS field, planned_type AS planned, opinion_type AS opinion, acceptable
      FROM opinions WHERE planned_type <> opinion_type
      UNION ALL SELECT record_id, 'priority', planned_priority, opinion_priority, ''
      FROM opinions WHERE planned_priority <> opinion_priority),
    g AS (SELECT record_id, field, any_value(planned) AS planned, count(*) AS runs_contested,
                 list_sort(list(DISTINCT opinion)) AS seen, any_value(acceptable) AS acceptable
          FROM f GROUP BY 1, 2),
    c AS (SELECT record_id, field, planned, runs_contested, array_to_string(seen, '|') AS second_opinions,
                 runs_contested = 7 AS always,
                 acceptable <> '' AND list_has_all(string_split(acceptable, ','), seen) AS documented
          FROM g)
    SELECT *, always AND NOT documented AS outstanding FROM c"""


@query("a15_contested_labels", _CONTESTED)
def _(t):
    return agree.contested(opinions(t), 7).withColumn(
        "second_opinions", F.array_join("second_opinions", "|"))


@query("o4_most_contested", f"""
    SELECT record_id, field, runs_contested, row_number() OVER
      (ORDER BY runs_contested DESC, record_id, field) AS place FROM ({_CONTESTED})
    ORDER BY place LIMIT 50""")
def _(t):
    top = agree.most_contested(agree.contested(opinions(t), 7)).limit(50)
    # At most 50 rows reach the numbering: the limit is the feature.
    from pyspark.sql import Window
    return top.select("record_id", "field", "runs_contested").withColumn(
        "place", F.row_number().over(
            Window.orderBy(F.desc("runs_contested"), "record_id", "field")))
