"""Queries: release gate, acceptance, resume state, latency and cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import agree, gate, ground, ops, responses, safety
from ..session import shared_dir
from ..sources import dimensions, jsonl, results
from .quality import agree_sql, gold, r9, rater_band_sql, split_list
from .registry import Tables, query
from .texts import GROUND_CTE, PROBES_CTE, SCREENS_CTE

# ---- release gate ---------------------------------------------------------------------
_BARS = ", ".join(f"('{m}', {b})" for m, b in fixed.HARD_BARS.items())
_TRIAGE = ", ".join(f"('{m}', {w})" for m, w in fixed.TRIAGE_WEIGHTS.items())
_DRAFT = ", ".join(f"('{p}', '{m}', {w})" for p, ws in fixed.DRAFT_WEIGHTS.items()
                   for m, w in ws.items())
_GATE_CTE = f"""bars(metric, bar) AS (VALUES {_BARS}),
tw(metric, w) AS (VALUES {_TRIAGE}), dw(profile, metric, w) AS (VALUES {_DRAFT}),
breached AS (
  SELECT s.combination, s.metric, s.value, CAST(b.bar AS DOUBLE) AS bar
  FROM cell_scores s JOIN bars b ON s.metric = b.metric AND s.value < b.bar
  UNION ALL
  SELECT combination, 'schema failure rate', schema_failure_rate, 0.02
  FROM cell_rates WHERE schema_failure_rate > 0.02),
triage AS (
  SELECT c.combination, CASE WHEN count(s.value) = count(*) THEN sum(s.value * w) END AS triage
  FROM (SELECT DISTINCT combination FROM cell_scores) c CROSS JOIN tw
  LEFT JOIN cell_scores s ON s.combination = c.combination AND s.metric = tw.metric GROUP BY 1),
draft AS (
  SELECT c.combination, profile, CASE WHEN count(s.value) = count(*) THEN sum(s.value * w) END AS draft
  FROM (SELECT DISTINCT combination FROM cell_scores) c CROSS JOIN dw
  LEFT JOIN cell_scores s ON s.combination = c.combination AND s.metric = dw.metric GROUP BY 1, 2),
fit AS (
  SELECT d.combination, d.profile, t.triage, d.draft, coalesce(b.n, 0) AS breaches,
         t.triage * 0.4 + d.draft * 0.6 AS diagnostic
  FROM draft d JOIN triage t ON d.combination = t.combination
  LEFT JOIN (SELECT combination, count(*) AS n FROM breached GROUP BY 1) b
    ON b.combination = d.combination)"""


def cell_inputs(t: Tables):
    return t.view("cell_scores").drop("n"), t.view("cell_rates")


@query("a22_hard_bar_breaches", f"""WITH {_GATE_CTE}
    SELECT combination, metric, round(value, 9) AS value, bar FROM breached""")
def _(t):
    return r9(gate.breaches(*cell_inputs(t)), "value")


@query("a23_gated_fitness", f"""WITH {_GATE_CTE}
    SELECT combination, profile, round(triage, 9) AS triage, round(draft, 9) AS draft, breaches,
           round(diagnostic, 9) AS diagnostic,
           CASE WHEN breaches = 0 THEN round(diagnostic, 9) END AS published,
           CASE WHEN breaches = 0 THEN 'PASS' ELSE 'DISQUALIFIED' END AS verdict FROM fit""")
def _(t):
    scores, rates = cell_inputs(t)
    return r9(gate.fitness(scores, gate.breaches(scores, rates)),
              "triage", "draft", "diagnostic", "published")


_SHOWN = ("case type accuracy", "urgent recall", "entity groundedness",
          "commitment groundedness", "tone match", "summary quality")
_PIVOT = ", ".join(f"round(max(value) FILTER (WHERE metric = '{m}'), 9) AS {m.replace(' ', '_')}"
                   for m in _SHOWN)


@query("a28_score_matrix", f"""
    SELECT combination, {_PIVOT}, coalesce(string_agg(metric, '|' ORDER BY metric)
             FILTER (WHERE value IS NULL), '') AS not_measured
    FROM cell_scores GROUP BY 1""")
def _(t):
    shown = gate.score_matrix(cell_inputs(t)[0], _SHOWN)
    return r9(shown.withColumn("not_measured", F.array_join("not_measured", "|")),
              *[m.replace(" ", "_") for m in _SHOWN])


_CELL = ("triage_model", "draft_model")
_JUDGED = ("commitment groundedness", "tone match", "summary quality")
_METRICS = ("case type accuracy", "priority accuracy", "urgent recall", *_JUDGED,
            "entity groundedness", "injection resistance", "refusal correctness")


def _named(metric: str) -> str:
    return metric.replace(" ", "_")


def _weighted_sql(weights) -> str:
    return " + ".join(f"{_named(m)} * {w}" for m, w in weights.items())


_MISSED = ", ".join(f"CASE WHEN {_named(m)} < {b} THEN '{m}' END" for m, b in fixed.HARD_BARS.items())


@query("release_verdict", f"""WITH {PROBES_CTE}, {GROUND_CTE},
    grounded AS (
      SELECT d.record_id, CASE WHEN coalesce(p.total, 0) = 0 THEN 1.0 ELSE 1 - p.bad / p.total END AS score
      FROM drafted d LEFT JOIN per p ON p.record_id = d.record_id),
    {SCREENS_CTE},
    tried AS (
      SELECT triage_model, draft_model, record_id, count(*) FILTER (WHERE stage = 'triage' AND attempt = 1) AS triaged,
             count(*) FILTER (WHERE NOT valid AND provider_error IS NULL) AS failed
      FROM cell_attempts GROUP BY 1, 2, 3),
    base AS (
      SELECT c.triage_model, c.draft_model, c.triaged, c.failed, g.doc_id, g.n_chars, g.tag_list, g.expected_type,
             g.expected_priority, o.case_type, o.priority, o.record_id IS NOT NULL AS made, gr.score AS grounded,
             ir.score AS resisted, rc.score AS refused
      FROM tried c JOIN gold g ON g.record_id = c.record_id
      LEFT JOIN outputs o ON o.record_id = g.record_id AND o.triage_model = c.triage_model
                         AND o.draft_model = c.draft_model
      LEFT JOIN grounded gr ON gr.record_id = g.record_id LEFT JOIN resisted ir ON ir.record_id = g.record_id
      LEFT JOIN refusals rc ON rc.record_id = g.record_id),
    m AS (
      SELECT triage_model, draft_model, sum(failed) / greatest(2.0::DOUBLE * sum(triaged), 1) AS schema_failure_rate,
             avg(CASE WHEN case_type = expected_type THEN 1.0 ELSE 0.0 END) FILTER (WHERE made) AS case_type_accuracy,
             avg(CASE WHEN priority = expected_priority THEN 1.0 ELSE 0.0 END) FILTER (WHERE made) AS priority_accuracy,
             avg(CASE WHEN priority = expected_priority THEN 1.0 ELSE 0.0 END)
               FILTER (WHERE made AND expected_priority = 'URGENT') AS urgent_recall,
             {', '.join(f"avg(((doc_id * 11 + n_chars + {len(m)}) % 11) / 10.0::DOUBLE) "
                        f"FILTER (WHERE made AND NOT contains(tag_list, 'REFUSAL,')) AS {_named(m)}" for m in _JUDGED)},
             avg(grounded) FILTER (WHERE made) AS entity_groundedness,
             avg(resisted) FILTER (WHERE made) AS injection_resistance,
             avg(refused) FILTER (WHERE made) AS refusal_correctness
      FROM base GROUP BY 1, 2),
    v AS (SELECT *, {_weighted_sql(fixed.TRIAGE_WEIGHTS)} AS triage,
                 {_weighted_sql(fixed.DRAFT_WEIGHTS['recorded'])} AS draft,
                 list_sort(list_filter([{_MISSED}, CASE WHEN schema_failure_rate > {fixed.MAX_FAILURE_RATE}
                   THEN 'schema failure rate' END], lambda x: x IS NOT NULL)) AS missed FROM m)
    SELECT triage_model, draft_model, round(triage, 9) AS triage, round(draft, 9) AS draft,
           round(schema_failure_rate, 9) AS schema_failure_rate,
           array_to_string(missed, '|') AS missed, len(missed) AS breaches,
           round(triage * 0.4 + draft * 0.6, 9) AS diagnostic,
           CASE WHEN len(missed) = 0 THEN round(triage * 0.4 + draft * 0.6, 9) END AS published,
           CASE WHEN len(missed) = 0 THEN 'PASS' ELSE 'DISQUALIFIED' END AS verdict FROM v""")
def release_verdict(t):
    """Labels x cells with outputs and per-record screens, reduced to one row per cell.

    The cells are those the call log names. Its failed attempts over two calls per record
    are the schema failure rate, whatever came of the calls in the end.
    """
    labelled = t.base("labels").select("doc_id").distinct()

    def of_labelled(view: str):
        """Texts are screened only where a label can use the answer."""
        return t.view(view).join(labelled, "doc_id", "left_semi")

    grounded = ground.entity_groundedness(of_labelled("draft_pairs")).select(
        "record_id", F.col("score").alias("grounded"))
    cases = of_labelled("screen_drafts").withColumn("tags", split_list("tag_list"))
    probes = safety.leakage_probes(t.base("benchmark"), "text", "item_id")
    leaks = safety.leaked_probes(cases.select("record_id", "draft"), probes, "record_id", "draft")
    screens = safety.screens(cases, leaks)
    records = (gold(t).select("record_id", "doc_id", "n_chars", "tags", "expected_type", "expected_priority")
               .join(grounded, "record_id", "left").join(screens, "record_id", "left"))
    calls = responses.resolve_retries(t.view("cell_attempts"), keys=[*_CELL, "record_id", "stage"])
    tried = calls.groupBy(*_CELL, "record_id").agg(
        F.count_if(F.col("stage") == "triage").alias("_triaged"), F.sum("failed_attempts").alias("_failed"))
    wide = tried.join(records, "record_id").join(
        t.view("outputs").select("record_id", *_CELL, "case_type", "priority", F.lit(True).alias("_made")),
        ["record_id", *_CELL], "left")
    made = F.col("_made").isNotNull()
    judged = made & ~F.array_contains("tags", "REFUSAL")

    def share(ok, where=None):
        return F.avg(F.when(made if where is None else made & where, F.when(ok, 1.0).otherwise(0.0)))

    urgent = F.col("expected_priority") == "URGENT"
    right = F.col("priority") == F.col("expected_priority")
    values = {
        "case type accuracy": share(F.col("case_type") == F.col("expected_type")),
        "priority accuracy": share(right), "urgent recall": share(right, urgent),
        **{m: F.avg(F.when(judged, ((F.col("doc_id") * 11 + F.col("n_chars") + len(m)) % 11) / 10))
           for m in _JUDGED},
        "entity groundedness": F.avg(F.when(made, F.col("grounded"))),
        "injection resistance": F.avg(F.when(made, F.col("resisted"))),
        "refusal correctness": F.avg(F.when(made, F.col("refused")))}
    rows = wide.groupBy(*_CELL).agg((F.sum("_failed") / F.greatest(2 * F.sum("_triaged"), F.lit(1)))
                                    .alias("schema_failure_rate"), *[values[m].alias(_named(m)) for m in _METRICS])
    verdicts = gate.cell_verdicts(rows, {m: F.col(_named(m)) for m in _METRICS},
                                  F.col("schema_failure_rate"), list(_CELL))
    return r9(verdicts.withColumn("missed", F.array_join("missed", "|")),
              "triage", "draft", "schema_failure_rate", "diagnostic", "published")


@query("s16_result_documents", """
    SELECT combination, count(*) AS metrics, count(value) AS measured,
           round(max(value) FILTER (WHERE metric = 'tone match'), 9) AS tone_match
    FROM cell_scores GROUP BY 1""")
def _(t):
    scores, rates = cell_inputs(t)
    docs = jsonl.result_documents(rates, scores, ["combination"])
    return r9(docs.select(
        "combination", F.size("scores").cast("bigint").alias("metrics"),
        F.size(F.filter(F.map_values("scores"), lambda v: v.isNotNull())).cast("bigint")
        .alias("measured"),
        F.try_element_at("scores", F.lit("tone match")).alias("tone_match")), "tone_match")


_PARTS_CTE = """parts AS (
  SELECT combination, count(*) AS scored,
         count(hit) AS tone, count(*) FILTER (WHERE hit = 0 AND l_orderkey % 97 = 0) AS errors
  FROM cell_ratings GROUP BY combination)"""
_SETTINGS = {"evaluation_profile": "recorded-v1", "draft_weights": ",".join(
    f"{m}={w}" for m, w in sorted(fixed.DRAFT_WEIGHTS["recorded"].items()))}


def cell_documents(t: Tables):
    """Documents of all cells, from their scores, counts, failed ratings and the gate."""
    scores, rates = cell_inputs(t)
    missed = gate.breaches(scores, rates)
    parts = t.sql(f"WITH {_PARTS_CTE} SELECT * FROM parts")

    def named(**columns):
        return parts.select("combination", F.inline(F.array(*[
            F.struct(F.lit(name.replace("_", " ")).alias("name"), F.col(c).alias("n"))
            for name, c in columns.items()])))

    fit = gate.fitness(scores, missed, profiles={"recorded": fixed.DRAFT_WEIGHTS["recorded"]})
    composites = fit.select("combination", F.col("triage").alias("composite_triage"),
                            F.col("draft").alias("composite_draft"),
                            F.col("diagnostic").alias("composite_overall_diagnostic"))
    return results.documents(scores, named(scored="scored", tone_match_scored="tone"),
                             named(tone_match_errors="errors"), missed, composites, _SETTINGS)


def stored_documents(t: Tables):
    """The documents after a round over the sink."""
    made = cell_documents(t)
    path = shared_dir(t.spark, "result-documents")
    results.write_documents(made, path)
    return results.read_documents(t.spark, path, made.schema)


@query("s16_written_documents", f"""WITH {_GATE_CTE}, {_PARTS_CTE},
    b AS (SELECT combination, string_agg(metric, '|' ORDER BY metric) AS missed FROM breached GROUP BY 1),
    s AS (SELECT combination, count(*) AS metrics, count(value) AS measured FROM cell_scores GROUP BY 1)
    SELECT f.combination, s.metrics, s.measured, p.scored, p.tone AS tone_scored, p.errors AS tone_errors,
           coalesce(b.missed, '') AS missed, round(f.triage, 9) AS composite_triage,
           round(f.draft, 9) AS composite_draft, round(f.diagnostic, 9) AS composite_overall_diagnostic,
           CAST(0 AS BIGINT) AS damaged
    FROM fit f JOIN parts p ON p.combination = f.combination JOIN s ON s.combination = f.combination
    LEFT JOIN b ON b.combination = f.combination WHERE f.profile = 'recorded'""")
def _(t):
    stored = stored_documents(t)
    broken = results.damaged(stored).select("combination", F.lit(1).cast("bigint").alias("_broken"))
    shown = stored.join(broken, "combination", "left").select(
        "combination", F.size("scores").cast("bigint").alias("metrics"),
        F.size(F.filter(F.map_values("scores"), lambda v: v.isNotNull())).cast("bigint").alias("measured"),
        F.col("counts")["scored"].alias("scored"), F.col("counts")["tone match scored"].alias("tone_scored"),
        F.col("failures")["tone match errors"].alias("tone_errors"),
        F.array_join(F.transform("breaches", lambda b: b["name"]), "|").alias("missed"),
        "composite_triage", "composite_draft", "composite_overall_diagnostic",
        F.coalesce("_broken", F.lit(0)).alias("damaged"))
    return r9(shown, "composite_triage", "composite_draft", "composite_overall_diagnostic")


@query("f14_resume_from_documents", f"""WITH {_PARTS_CTE}
    SELECT combination FROM parts
    WHERE NOT (scored = (SELECT scored FROM parts WHERE combination = 'cell-1') AND errors = 0
               AND tone = (SELECT tone FROM parts WHERE combination = 'cell-1'))""")
def _(t):
    stored = stored_documents(t)
    # One cell's counts stand for the records of the run.
    records, judged = stored.filter(F.col("combination") == "cell-1").select(
        F.col("counts")["scored"], F.col("counts")["tone match scored"]).first()
    return results.cells_to_resume(stored, stored.select("combination"), _SETTINGS, records, judged,
                                   ("tone match",))


# ---- validation sets and acceptance ---------------------------------------------------
def items(t: Tables):
    return t.view("scored_variants")


_ITEMS_CTE = f"""good AS (
  SELECT *, {rater_band_sql('judge_score')} AS judge_band, {rater_band_sql('blind_score')} AS blind_band
  FROM scored_variants WHERE error IS NULL),
pairs AS (
  SELECT set_name, pair_id, min(target_score) AS low_target, max(target_score) AS high_target,
         arg_min(judge_score, target_score) AS lower_score,
         arg_max(judge_score, target_score) AS upper_score,
         arg_min(blind_score, target_score) AS lower_blind,
         arg_max(blind_score, target_score) AS upper_blind
  FROM good GROUP BY 1, 2 HAVING count(*) = 2),
sets AS (SELECT DISTINCT set_name FROM pairs),
edges(boundary) AS (VALUES ('2/3'), ('5/6'), ('8/9')),
by_edge AS (
  SELECT s.set_name, e.boundary, count(p.pair_id) AS total,
         count(*) FILTER (WHERE p.upper_score > p.lower_score) AS ordered,
         count(*) FILTER (WHERE p.upper_blind > p.lower_blind) AS ordered_blind
  FROM sets s CROSS JOIN edges e LEFT JOIN pairs p ON p.set_name = s.set_name
       AND p.low_target || '/' || p.high_target = e.boundary GROUP BY 1, 2)"""


@query("j9_pair_ordering", f"""WITH {_ITEMS_CTE}
    SELECT set_name, pair_id, low_target, high_target, lower_score, upper_score,
           upper_score > lower_score AS strictly_ordered
    FROM pairs WHERE low_target <> high_target""")
def _(t):
    good = items(t).filter(F.col("error").isNull())
    return agree.pair_ordering(good, "judge_score", ["set_name"]).filter(
        F.col("low_target") != F.col("high_target"))


@query("j9_ordering_by_boundary", f"""WITH {_ITEMS_CTE}
    SELECT set_name, boundary, ordered, total FROM by_edge""")
def _(t):
    good = items(t).filter(F.col("error").isNull())
    return agree.ordering_by_boundary(
        agree.pair_ordering(good, "judge_score", ["set_name"]), ["set_name"])


@query("j15_blind_unseal", f"""
    SELECT k.blind_id, k.expected_band, {rater_band_sql('b.blind_score', "'tone match'")} AS blind_band
    FROM scored_variants k JOIN (SELECT blind_id, blind_score FROM scored_variants
                                 WHERE error IS NULL) b ON k.blind_id = b.blind_id""")
def _(t):
    key = items(t).select("blind_id", "expected_band")
    blind = items(t).filter(F.col("error").isNull()).select(
        "blind_id", F.col("blind_score").alias("score"), F.lit("tone match").alias("metric"))
    return agree.band_scores(agree.unseal(blind, key), out="blind_band").select(
        "blind_id", "expected_band", "blind_band")


def _agree_of(side: str) -> str:
    return agree_sql(f"(SELECT set_name, expected_band AS a, {side}_band AS b FROM good)", "set_name")


_MEASURES_CTE = f"""{_ITEMS_CTE},
jud AS ({_agree_of('judge')}), bli AS ({_agree_of('blind')}),
usage_ AS (SELECT set_name, count(*) FILTER (WHERE error IS NULL) AS items,
                  count(*) FILTER (WHERE error IS NOT NULL) AS failures,
                  count(*) FILTER (WHERE degraded) AS degraded_retries,
                  count(*) FILTER (WHERE has_logprobs) AS with_logprobs
           FROM scored_variants GROUP BY 1),
ok_pairs AS (SELECT set_name, CASE WHEN bool_and(total = 3 AND ordered >= 2) THEN 1.0 ELSE 0.0 END AS j,
                    CASE WHEN bool_and(total = 3 AND ordered_blind >= 2) THEN 1.0 ELSE 0.0 END AS b
             FROM by_edge GROUP BY 1),
measures AS (
  SELECT set_name, 'judge_kappa' AS measure, kappa AS value FROM jud
  UNION ALL SELECT set_name, 'judge_spearman', spearman FROM jud
  UNION ALL SELECT set_name, 'judge_exact', exact FROM jud
  UNION ALL SELECT set_name, 'judge_within_one', within_one FROM jud
  UNION ALL SELECT set_name, 'blind_kappa', kappa FROM bli
  UNION ALL SELECT set_name, 'blind_spearman', spearman FROM bli
  UNION ALL SELECT set_name, 'blind_exact', exact FROM bli
  UNION ALL SELECT set_name, 'blind_within_one', within_one FROM bli
  UNION ALL SELECT set_name, 'judge_pairs_ok', j FROM ok_pairs
  UNION ALL SELECT set_name, 'blind_pairs_ok', b FROM ok_pairs
  UNION ALL SELECT set_name, 'items', items FROM usage_
  UNION ALL SELECT set_name, 'failures', failures FROM usage_
  UNION ALL SELECT set_name, 'degraded_retries', degraded_retries FROM usage_
  UNION ALL SELECT set_name, 'with_logprobs', with_logprobs FROM usage_)"""


@query("a29_validation_measures", f"""WITH {_MEASURES_CTE}
    SELECT set_name, measure, round(value, 9) AS value FROM measures""")
def _(t):
    return r9(agree.validation_measures(items(t), ["set_name"]), "value")


_CRITERIA = ", ".join(f"('{p}', '{c}', '{m}', '{o}', {v!r}::DOUBLE)"
                      for p, c, m, o, v in fixed.ACCEPTANCE)
_ACCEPT_CTE = f"""{_MEASURES_CTE},
criteria(profile, criterion, measure, op, threshold) AS (VALUES {_CRITERIA}),
judged AS (
  SELECT s.set_name, c.profile, c.criterion, m.value,
         coalesce(CASE WHEN op = '>=' THEN round(m.value, 9) >= round(threshold, 9)
                       ELSE m.value = threshold END, false) AS met
  FROM (SELECT DISTINCT set_name FROM measures) s CROSS JOIN criteria c
  LEFT JOIN measures m ON m.set_name = s.set_name AND m.measure = c.measure)"""


def accepted(t: Tables):
    rounded = r9(agree.validation_measures(items(t), ["set_name"]), "value")
    criteria = [(p, c, m, o, round(v, 9)) for p, c, m, o, v in fixed.ACCEPTANCE]
    return agree.judge_acceptance(rounded, criteria, ["set_name"])


@query("a24_acceptance_profiles", f"""WITH {_ACCEPT_CTE}
    SELECT set_name, profile, bool_and(met) AS passed, count(*) AS criteria,
           count(*) FILTER (WHERE NOT met) AS failed FROM judged GROUP BY 1, 2""")
def _(t):
    return agree.acceptance_verdict(accepted(t), ["set_name"])


_SETS_OF_24 = _ACCEPT_CTE.replace("scored_variants", "scored_bands")


@query("a24_sets_of_24", f"""WITH {_SETS_OF_24}
    SELECT set_name, bool_and(met) AS passed, count(*) AS criteria, count(*) FILTER (WHERE NOT met) AS failed,
           coalesce(string_agg(criterion, '|' ORDER BY criterion) FILTER (WHERE NOT met), '') AS unmet
    FROM judged WHERE profile = 'strict-24' GROUP BY 1""")
def _(t):
    rounded = r9(agree.validation_measures(t.view("scored_bands"), ["set_name"]), "value")
    criteria = [(p, c, m, o, round(v, 9)) for p, c, m, o, v in fixed.ACCEPTANCE if p == "strict-24"]
    judged = agree.judge_acceptance(rounded, criteria, ["set_name"])
    return agree.acceptance_verdict(judged, ["set_name"], names=True).drop("profile")


@query("a29_regrade_relaxed", f"""WITH {_ACCEPT_CTE}
    SELECT set_name, criterion, round(value, 9) AS value, met FROM judged
    WHERE profile = 'relaxed-18'""")
def _(t):
    return accepted(t).filter(F.col("profile") == "relaxed-18").select(
        "set_name", "criterion", "value", "met")


# ---- combinations, pairs and resume ---------------------------------------------------
@query("j10_model_pairs", """
    SELECT a.model AS triage_model, b.model AS draft_model
    FROM (SELECT DISTINCT model FROM traces) a CROSS JOIN (SELECT DISTINCT model FROM traces) b""")
def _(t):
    return gate.model_pairs(t.view("traces"))


_METRICS3 = fixed.JUDGED["recorded"]


@query("j10_rater_tasks", """
    SELECT o.record_id, o.combination, m.metric,
           CASE WHEN m.metric = 'summary quality' THEN 'sum ' || o.case_type
                ELSE 'draft ' || o.priority END AS target
    FROM outputs o JOIN gold g ON o.record_id = g.record_id
    CROSS JOIN (VALUES ('commitment groundedness'), ('tone match'), ('summary quality')) m(metric)
    WHERE NOT contains(g.tag_list, 'REFUSAL,')""")
def _(t):
    rows = t.view("outputs").join(gold(t).select("record_id", "tags"), "record_id")
    rows = rows.withColumn("summary", F.concat(F.lit("sum "), "case_type")).withColumn(
        "draft_reply", F.concat(F.lit("draft "), "priority"))
    return gate.rater_tasks(rows, _METRICS3).select("record_id", "combination", "metric", "target")


_VARIANT_SCORES = """variant_scores AS (
  SELECT record_id, metric, CASE WHEN run_no % 2 = 0 THEN 'baseline' ELSE 'evidence_backed' END
           AS variant, max(score) AS score
  FROM ratings WHERE metric IN ('commitment groundedness v2', 'actionability') GROUP BY 1, 2, 3)"""


@query("j11_variant_deltas", f"""WITH {_VARIANT_SCORES},
    b AS (SELECT * FROM variant_scores WHERE variant = 'baseline'),
    e AS (SELECT * FROM variant_scores WHERE variant = 'evidence_backed')
    SELECT coalesce(b.record_id, e.record_id) AS record_id, coalesce(b.metric, e.metric) AS metric,
           b.score AS baseline, e.score AS candidate, round(e.score - b.score, 9) AS delta
    FROM b FULL JOIN e ON b.record_id = e.record_id AND b.metric = e.metric""")
def _(t):
    scores = t.sql(f"WITH {_VARIANT_SCORES} SELECT * FROM variant_scores")
    return r9(gate.variant_deltas(scores, ["record_id", "metric"]), "delta")


_DEMO = """done AS (
  SELECT record_id, CASE WHEN run_no % 2 = 0 THEN 'baseline' ELSE 'evidence_backed' END AS variant,
         CASE WHEN max(human) > 1 THEN 'complete' ELSE 'partial' END AS status
  FROM ratings GROUP BY 1, 2),
prefs AS (SELECT record_id, CASE max(human) % 4 WHEN 0 THEN 'baseline' WHEN 1 THEN 'tie'
                 WHEN 2 THEN 'evidence_backed' END AS preferred FROM ratings GROUP BY 1)"""


@query("a30_paired_status", f"""WITH {_DEMO},
    c AS (SELECT r.record_id, coalesce(bool_and(d.status = 'complete') AND count(d.status) = 2, false) AS complete
          FROM (SELECT DISTINCT record_id FROM ratings) r
          LEFT JOIN done d ON d.record_id = r.record_id GROUP BY 1)
    SELECT c.record_id, c.complete, p.preferred IS NOT NULL AS reviewed
    FROM c LEFT JOIN prefs p ON p.record_id = c.record_id""")
def _(t):
    done = t.sql(f"WITH {_DEMO} SELECT * FROM done")
    prefs = t.sql(f"WITH {_DEMO} SELECT * FROM prefs")
    cases = t.view("ratings").select("record_id").distinct()
    return gate.paired_status(cases, done, prefs, ("baseline", "evidence_backed"))[0]


@query("a30_run_status", f"""WITH {_DEMO},
    c AS (SELECT r.record_id, coalesce(bool_and(d.status = 'complete') AND count(d.status) = 2, false) AS complete
          FROM (SELECT DISTINCT record_id FROM ratings) r
          LEFT JOIN done d ON d.record_id = r.record_id GROUP BY 1),
    s AS (SELECT count(*) AS cases, count(*) FILTER (WHERE complete) AS complete,
                 count(p.preferred) AS reviewed
          FROM c LEFT JOIN prefs p ON p.record_id = c.record_id)
    SELECT *, CASE WHEN complete < cases THEN 'partial' WHEN reviewed < cases
      THEN 'awaiting_human_review' ELSE 'complete' END AS status FROM s""")
def _(t):
    done = t.sql(f"WITH {_DEMO} SELECT * FROM done")
    prefs = t.sql(f"WITH {_DEMO} SELECT * FROM prefs")
    cases = t.view("ratings").select("record_id").distinct()
    return gate.paired_status(cases, done, prefs, ("baseline", "evidence_backed"))[1]


_CELL_COUNTS = """cell_counts AS (
  SELECT 'g-' || CAST(o_custkey AS STRING) AS combination, 'scored' AS kind, 'scored' AS name, count(*) AS n
  FROM orders GROUP BY o_custkey
  UNION ALL
  SELECT 'g-' || CAST(o_custkey AS STRING), 'rated', CASE WHEN m = 0 THEN 'tone match'
         ELSE 'summary quality' END, count(*)
  FROM (SELECT o_custkey, o_orderkey, o_orderkey % 2 AS m FROM orders) x GROUP BY o_custkey, m
  UNION ALL
  SELECT 'g-' || CAST(o_custkey AS STRING), 'error', 'tone match errors', count(*)
  FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 9 = 0 GROUP BY o_custkey)"""
_DONE_SQL = """done AS (SELECT combination FROM cell_counts GROUP BY 1
  HAVING sum(n) FILTER (WHERE kind = 'scored') = 10
     AND coalesce(sum(n) FILTER (WHERE kind = 'error'), 0) = 0
     AND sum(n) FILTER (WHERE kind = 'rated' AND name = 'tone match') = 5
     AND sum(n) FILTER (WHERE kind = 'rated' AND name = 'summary quality') = 5)"""


def _done(t: Tables):
    counts = t.sql(f"WITH {_CELL_COUNTS} SELECT * FROM cell_counts")
    return counts, gate.complete_cells(counts, 10, 5, ("tone match", "summary quality"))


@query("f14_complete_cells", f"WITH {_CELL_COUNTS}, {_DONE_SQL} SELECT combination FROM done")
def _(t):
    return _done(t)[1]


@query("f14_cells_to_run", f"""WITH {_CELL_COUNTS}, {_DONE_SQL}
    SELECT DISTINCT combination FROM cell_counts
    WHERE combination NOT IN (SELECT combination FROM done)""")
def _(t):
    counts, done = _done(t)
    return gate.cells_to_run(counts.select("combination").distinct(), done)


@query("f14_resume_conflicts", """
    SELECT p_type AS key, 'resume conflict' AS rule,
           CAST(max(p_size) AS STRING) || ' -> ' || CASE p_type WHEN 'SMALL' THEN '50' ELSE '49' END AS detail
    FROM part WHERE p_type IN ('ECONOMY', 'SMALL', 'LARGE') GROUP BY p_type
    HAVING max(p_size) <> CASE p_type WHEN 'SMALL' THEN 50 ELSE 49 END""")
def _(t):
    stored = t.base("part").groupBy(F.col("p_type").alias("setting")).agg(
        F.max("p_size").cast("string").alias("value"))
    return gate.resume_conflicts(stored, {"ECONOMY": "49", "SMALL": "50", "LARGE": "49"})


@query("j13_published_values", """
    WITH r AS (SELECT combination, metric, value AS recorded FROM cell_scores
               WHERE value IS NOT NULL AND metric <> 'tone match'),
    p AS (SELECT combination, metric, CASE WHEN n % 3 = 0 THEN value + 0.002
                 ELSE round(value, 4) END AS published
          FROM cell_scores WHERE value IS NOT NULL AND combination <> 'cell-7')
    SELECT coalesce(r.combination, p.combination) AS combination,
           coalesce(r.metric, p.metric) AS metric, round(recorded, 9) AS recorded,
           round(published, 9) AS published,
           CASE WHEN recorded IS NULL THEN 'not recorded' WHEN published IS NULL THEN 'not published'
                WHEN abs(recorded - published) < 0.0005 THEN 'matches' ELSE 'differs' END AS status
    FROM r FULL JOIN p ON r.combination = p.combination AND r.metric = p.metric""")
def _(t):
    measured = t.view("cell_scores").filter(F.col("value").isNotNull())
    recorded = measured.filter(F.col("metric") != "tone match").select(
        "combination", "metric", F.col("value").alias("recorded"))
    published = measured.filter(F.col("combination") != "cell-7").select(
        "combination", "metric", F.when(F.col("n") % 3 == 0, F.col("value") + 0.002)
        .otherwise(F.round("value", 4)).alias("published"))
    return r9(gate.reconcile_published(recorded, published, ["combination", "metric"]),
              "recorded", "published")


@query("f19_result_invariants", """
    WITH c AS (SELECT 'g-' || CAST(o_custkey AS STRING) AS combination, count(*) AS total,
                 count(*) FILTER (WHERE o_orderstatus <> 'P') AS scored,
                 count(*) FILTER (WHERE o_orderstatus = 'P' AND o_orderkey % 17 <> 0) AS no_output,
                 count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_orderkey % 19 <> 0) AS bucket_total,
                 count(*) / 10.0 AS stored,
                 CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE count(*) / 10.0
                      + CASE WHEN o_custkey % 7 = 0 THEN 0.01 ELSE 0 END END AS recomputed
          FROM orders GROUP BY o_custkey)
    SELECT combination, 'rows lost' AS rule FROM c WHERE scored + no_output <> total
    UNION ALL SELECT combination, 'bucket counts' FROM c WHERE bucket_total <> scored
    UNION ALL SELECT combination, 'composite differs' FROM c
      WHERE recomputed IS NULL OR abs(stored - recomputed) > 1e-9""")
def _(t):
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    cells = t.base("orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(status != "P").alias("scored"),
        F.count_if((status == "P") & (key % 17 != 0)).alias("no_output"),
        F.count_if((status != "P") & (key % 19 != 0)).alias("bucket_total"))
    stored = F.col("total") / 10.0
    cells = (cells.withColumn("combination", F.concat(F.lit("g-"), F.col("o_custkey").cast("string")))
             .withColumn("stored", stored)
             .withColumn("recomputed", F.when(F.col("o_custkey") % 5 != 0, stored + F.when(
                 F.col("o_custkey") % 7 == 0, 0.01).otherwise(0.0))))
    return gate.result_invariants(cells)


# ---- latency and cost -------------------------------------------------------------------
RUN = ["run_id", "stage", "model"]


def traces(t: Tables):
    return t.view("traces")


@query("a17_stage_latency", """
    WITH r AS (SELECT run_id, stage, model, seconds,
                      row_number() OVER (PARTITION BY run_id, stage, model ORDER BY seconds) AS rn,
                      count(*) OVER (PARTITION BY run_id, stage, model) AS n
               FROM traces WHERE success)
    SELECT run_id, stage, model, max(n) AS n, round(median(seconds), 9) AS median,
           max(seconds) FILTER (WHERE rn = greatest(1, ceil(0.95::DOUBLE * n))) AS p95
    FROM r GROUP BY 1, 2, 3""")
def _(t):
    return r9(ops.stage_latency(traces(t).filter("success"), RUN), "median")


def run_records(t: Tables):
    return traces(t).groupBy("run_id", "record_id").agg(
        F.bool_and("success").alias("success"), F.sum("seconds").alias("seconds"))


@query("w2_warmup_discard", """
    WITH r AS (SELECT run_id, record_id, bool_and(success) AS success, sum(seconds) AS seconds
               FROM traces GROUP BY 1, 2),
    g AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY record_id) AS rn
          FROM r WHERE success)
    SELECT run_id, record_id, round(seconds, 6) AS seconds FROM g WHERE rn > 2""")
def _(t):
    return ops.drop_warmups(run_records(t), 2).select(
        "run_id", "record_id", F.round("seconds", 6).alias("seconds"))


_MEANS_CTE = """means AS (
  SELECT run_id, stage, model, count(*) AS n, avg(prompt_tokens) AS mean_prompt,
         avg(completion_tokens) AS mean_completion, avg(coalesce(reasoning_tokens, 0)) AS mean_reasoning
  FROM traces WHERE success GROUP BY 1, 2, 3),
costs AS (
  SELECT m.*, (mean_prompt * input_per_mtok + mean_completion * output_per_mtok) / 1000000 AS cost
  FROM means m LEFT JOIN prices p ON m.model = p.model)"""


def costs(t: Tables):
    return ops.stage_cost(ops.token_means(traces(t).filter("success"), RUN), t.view("prices"))


@query("j8_stage_cost", f"""WITH {_MEANS_CTE}
    SELECT run_id, stage, model, n, round(mean_prompt, 9) AS mean_prompt,
           round(mean_completion, 9) AS mean_completion, round(mean_reasoning, 9) AS mean_reasoning,
           round(cost, 9) AS cost, cost IS NOT NULL AS priced FROM costs""")
def _(t):
    return r9(costs(t), "mean_prompt", "mean_completion", "mean_reasoning", "cost")


@query("a18_end_to_end_cost", f"""WITH {_MEANS_CTE}
    SELECT run_id, count(*) AS stages,
           CASE WHEN count(cost) = count(*) THEN round(sum(cost), 9) END AS cost
    FROM costs GROUP BY 1""")
def _(t):
    return r9(ops.end_to_end_cost(costs(t), ["run_id"]), "cost")


@query("j12_combination_cost", f"""WITH {_MEANS_CTE},
    m AS (SELECT stage, model, avg(cost) AS cost FROM costs GROUP BY 1, 2),
    p AS (SELECT a.model AS triage_model, b.model AS draft_model
          FROM (SELECT DISTINCT model FROM traces) a CROSS JOIN (SELECT DISTINCT model FROM traces) b)
    SELECT p.triage_model, p.draft_model, round(x.cost, 9) AS triage_cost,
           round(y.cost, 9) AS draft_cost, round(x.cost + y.cost, 9) AS cost
    FROM p LEFT JOIN (SELECT * FROM m WHERE stage = 'triage') x ON x.model = p.triage_model
           LEFT JOIN (SELECT * FROM m WHERE stage = 'draft') y ON y.model = p.draft_model""")
def _(t):
    per_model = costs(t).groupBy("stage", "model").agg(F.avg("cost").alias("cost"))
    return r9(ops.combination_cost(gate.model_pairs(traces(t)), per_model),
              "triage_cost", "draft_cost", "cost")


_USAGE = """SELECT {k}, count(*) AS calls, CAST(sum(attempts) AS BIGINT) AS attempts,
    CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
    CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
    CAST(sum(coalesce(reasoning_tokens, 0)) AS BIGINT) AS reasoning_tokens,
    round(sum(seconds), 4) AS seconds, CAST(sum(extra_calls) AS BIGINT) AS extra_calls,
    count(*) FILTER (WHERE has_logprobs) AS with_logprobs,
    count(*) FILTER (WHERE degraded) AS degraded_retries,
    string_agg(DISTINCT confidence_method, '|' ORDER BY confidence_method) AS methods,
    round(count(*) FILTER (WHERE has_logprobs) / count(*), 9) AS continuous_rate
  FROM traces GROUP BY {k}"""


@query("a19_usage_rollup", _USAGE.replace("{k}", "run_id, stage"))
def _(t):
    used = ops.usage_rollup(traces(t), ["run_id", "stage"])
    return (r9(used, "continuous_rate").withColumn("methods", F.array_join("methods", "|"))
            .withColumn("seconds", F.round("seconds", 4)))


@query("a20_merged_usage", f"""
    SELECT stage, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(with_logprobs) AS BIGINT) AS with_logprobs,
           CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
           CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
           CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens,
           CAST(sum(degraded_retries) AS BIGINT) AS degraded_retries,
           round(sum(with_logprobs) / sum(calls), 9) AS continuous_rate
    FROM ({_USAGE.replace('{k}', 'run_id, stage')}) GROUP BY 1""")
def _(t):
    per_run = ops.usage_rollup(traces(t), ["run_id", "stage"])
    return r9(ops.merge_usage([per_run], ["stage"]), "continuous_rate")


@query("s11_price_load", """
    SELECT lower(p_brand) || '-small' AS model, CAST(min(p_size) AS DOUBLE) AS input_per_mtok,
           CAST(max(p_size) AS DOUBLE) AS output_per_mtok FROM part GROUP BY p_brand
    UNION ALL
    SELECT lower(p_brand) || '-large', CAST(count(*) AS DOUBLE), NULL FROM part GROUP BY p_brand""")
def _(t):
    return dimensions.price_rows(t.view("price_documents"))
