"""Gate, validation, sampling, sources and review."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gradewright import fixed
from gradewright.functions import contract
from gradewright.operators import agree, gate, review, sample, validate
from gradewright.sources import dimensions, fingerprint, jsonl, merge

SCORES = "combination STRING, metric STRING, value DOUBLE"
PERFECT = [("c", m, 1.0) for m in {**fixed.HARD_BARS, **fixed.TRIAGE_WEIGHTS,
                                   **fixed.DRAFT_WEIGHTS["shadow"]}]


def no_rates(rows):
    return rows([], "combination STRING, schema_failure_rate DOUBLE")


@pytest.mark.parametrize("metric", sorted(fixed.HARD_BARS))
def test_every_bar_disqualifies(rows, metric):
    scores = rows([(c, m, v if m != metric else fixed.HARD_BARS[m] - 0.01) for c, m, v in PERFECT], SCORES)
    missed = gate.breaches(scores, no_rates(rows))
    assert [r.metric for r in missed.collect()] == [metric]
    assert {(r.verdict, r.published) for r in gate.fitness(scores, missed).collect()} == {
        ("DISQUALIFIED", None)}


def test_unmeasured_is_neither_breach_nor_zero(rows):
    scores = rows([(c, m, None if m == "tone match" else v) for c, m, v in PERFECT], SCORES)
    missed = gate.breaches(scores, no_rates(rows))
    assert missed.count() == 0
    for r in gate.fitness(scores, missed).collect():
        assert r.draft is None and r.diagnostic is None and r.triage == pytest.approx(1.0)
    row, = gate.score_matrix(scores, ("tone match", "urgent recall")).collect()
    assert row.tone_match is None and row.not_measured == ["tone match"]


def test_failure_rate_is_capped(rows):
    rates = rows([("c", 0.02), ("d", 0.021)], "combination STRING, schema_failure_rate DOUBLE")
    assert [r.combination for r in gate.breaches(rows([], SCORES), rates).collect()] == ["d"]


def test_recorded_fitness(rows):
    values = {"urgent recall": 0.9, "case type accuracy": 0.8, "priority accuracy": 0.7,
              "entity groundedness": 0.6, "commitment groundedness": 0.5, "tone match": 0.4,
              "summary quality": 0.3}
    scores = rows([("c", m, v) for m, v in values.items()], SCORES)
    row, = gate.fitness(scores, gate.breaches(scores, no_rates(rows)), profiles={
        "recorded": fixed.DRAFT_WEIGHTS["recorded"]}).collect()
    triage = 0.45 * 0.9 + 0.3 * 0.8 + 0.25 * 0.7
    draft = 0.35 * 0.6 + 0.35 * 0.5 + 0.15 * 0.4 + 0.15 * 0.3
    assert row.diagnostic == pytest.approx(0.4 * triage + 0.6 * draft)


def test_weights_sum_to_one():
    for weights in (fixed.TRIAGE_WEIGHTS, *fixed.DRAFT_WEIGHTS.values(), fixed.STAGE_SHARE):
        assert sum(weights.values()) == pytest.approx(1.0)


def test_only_complete_cells_are_reused(rows):
    data = [("a", "scored", "scored", 3), ("a", "rated", "m", 2), ("b", "scored", "scored", 3),
            ("b", "rated", "m", 1), ("c", "scored", "scored", 3), ("c", "rated", "m", 2),
            ("c", "error", "m errors", 1)]
    counts = rows(data, "combination STRING, kind STRING, name STRING, n INT")
    done = gate.complete_cells(counts, 3, 2, ("m",))
    assert [r.combination for r in done.collect()] == ["a"]


def test_missing_measure_fails_acceptance(rows):
    judged = agree.judge_acceptance(
        rows([("s", "items", 24.0)], "set_name STRING, measure STRING, value DOUBLE"),
        [("p", "items", "items", "=", 24.0), ("p", "kappa", "kappa", ">=", 0.85)], ["set_name"])
    row, = agree.acceptance_verdict(judged, ["set_name"]).collect()
    assert (row.passed, row.failed) == (False, 1)


def test_pair_ordering_is_strict_and_zero_filled(rows):
    items = rows([("p1", 2, 0.3), ("p1", 3, 0.3), ("p2", 5, 0.4), ("p2", 6, 0.6), ("p3", 8, 0.9)],
                 "pair_id STRING, target_score INT, judge_score DOUBLE")
    got = {r.boundary: (r.ordered, r.total)
           for r in agree.ordering_by_boundary(agree.pair_ordering(items)).collect()}
    assert got == {"2/3": (0, 1), "5/6": (1, 1), "8/9": (0, 0)}


RECORD = ("id STRING, subject STRING, body STRING, expected_type STRING, expected_priority STRING, "
          "acceptable_types ARRAY<STRING>, tags ARRAY<STRING>, must_not_assert ARRAY<STRING>, label_note STRING")


@pytest.mark.parametrize("change,rule", [
    ({"id": "ENQ-1"}, "malformed id"), ({"subject": " "}, "blank subject"),
    ({"subject": "s" * 301}, "subject too long"), ({"body": "b" * 20001}, "body too long"),
    ({"acceptable_types": ["OTHER"], "label_note": "n"}, "expected type not acceptable"),
    ({"acceptable_types": ["CLAIM"]}, "ambiguity without note"),
    ({"tags": ["REFUSAL"]}, "refusal names no bait"),
    ({"tags": ["ANGRY"], "expected_priority": "URGENT"}, "angry and urgent without reason"),
    ({"tags": ["MIXED_TOPIC"], "label_note": "n"}, "mixed topic lists no alternatives"),
    ({}, None)])
def test_record_rules(rows, change, rule):
    base = {"id": "ENQ-001", "subject": "s", "body": "b", "expected_type": "CLAIM",
            "expected_priority": "LOW", "acceptable_types": [], "tags": [], "must_not_assert": [],
            "label_note": None, **change}
    got = [r.rule for r in validate.record_violations(rows([tuple(base.values())], RECORD)).collect()]
    assert got == ([] if rule is None else [rule])


def quota_rows(rows, drop=None):
    types = list(fixed.CASE_TYPES)
    prio = ["URGENT"] * 10 + ["NORMAL"] * 20 + ["LOW"] * 10
    tags = {i: [] for i in range(40)}
    at = 0
    for tag, n in (("MIXED_TOPIC", 5), ("ANGRY", 4), ("MISSING_INFO", 4), ("REFUSAL", 2),
                   ("INJECTION", 2), ("NOISY", 6)):
        for _ in range(n):
            tags[at % 40].append(tag)
            at += 1
    if drop:
        tags = {i: [t for t in v if t != drop] for i, v in tags.items()}
    return rows([(types[i % 6], prio[i], tags[i]) for i in range(40)],
                "expected_type STRING, expected_priority STRING, tags ARRAY<STRING>")


def declared_quotas():
    return [(n, validate.gold_quota_predicate(c, v), a, b) for n, c, v, a, b in fixed.QUOTAS]


def test_quotas_are_met_and_enforced(rows):
    assert validate.quota_violations(quota_rows(rows), declared_quotas(), fixed.ROW_COUNT_BOUNDS).count() == 0
    broken = validate.quota_violations(quota_rows(rows, "NOISY"), declared_quotas(), (41, 50)).collect()
    assert {r.key for r in broken} == {"noisy", "record count"}
    with pytest.raises(ValueError):
        validate.quota_violations(quota_rows(rows), [("both", F.lit(True), 1, 1)])


def test_label_values_keep_booleans_apart(rows):
    data = [("a", "tone match", 1, "BOOLEAN"), ("b", "tone match", 10, "BIGINT"),
            ("c", "tone match", 11, "BIGINT"), ("d", "tone match", None, "VOID"),
            ("e", "tone match", None, "STRING"), ("f", "charm", 1, "BIGINT")]
    frame = rows(data, "record_id STRING, metric STRING, human INT, kind STRING")
    got = {(r.key.split("|")[0], r.rule) for r in validate.label_violations(frame, kind="kind").collect()}
    assert got == {("a", "not an integer 0-10"), ("c", "not an integer 0-10"),
                   ("e", "not an integer 0-10"), ("f", "unknown metric")}


@pytest.mark.parametrize("levels", [(1,), (2,), (1, 2), (1, 2, 3)])
def test_positions_equal_a_full_sort(rows, levels):
    keys = sorted({f"{(i * 7919) % 1000:03d}" for i in range(300)})
    frame = rows([(k,) for k in reversed(keys)], "k STRING")
    got = {r.k: r.position for r in sample.dense_positions(frame, "k", levels).collect()}
    assert got == {k: i for i, k in enumerate(keys, start=1)}


def test_stratified_sample_takes_turns(rows):
    data = [(f"{i:02d}", "A" if i < 10 else "B" if i < 12 else "C", ["REFUSAL"] if i == 0 else [])
            for i in range(13)]
    frame = rows(data, "record_id STRING, expected_type STRING, tags ARRAY<STRING>")
    got = sorted(r.record_id for r in sample.stratified_sample(frame, 6).collect())
    assert got == ["01", "02", "03", "10", "11", "12"]
    assert sample.stratified_sample(frame, 100).count() == 12


def test_blind_packet_hides_labels(rows):
    frame = rows([(f"v{i}", f"text {i}", i % 4) for i in range(30)], "variant_id STRING, text STRING, band INT")
    packet, key, header = sample.blind_packet(frame, "variant_id", ["text"], ["band"], "s", "B")
    assert packet.columns == ["blind_id", "text"] and packet.count() == 30
    again = sample.blind_packet(frame.orderBy(F.rand()), "variant_id", ["text"], ["band"], "s", "B")
    assert sorted(key.collect()) == sorted(again[1].collect())
    assert header.collect() == again[2].collect()
    with pytest.raises(ValueError):
        sample.blind_packet(frame, "variant_id", ["band"], ["band"], "s", "B")


# ---- sources -------------------------------------------------------------------------------
def test_strict_read_refuses_one_bad_line(spark, tmp_path):
    good = [{"id": f"ENQ-{i:03d}", "subject": "s", "body": "b"} for i in range(5)]
    path = tmp_path / "e.jsonl"
    path.write_text("\n\n".join(json.dumps(g) for g in good) + "\n")
    assert jsonl.read_strict(spark, str(path), contract.ENQUIRY).count() == 5
    path.write_text(path.read_text() + '{"id": "ENQ-009", "subject": 3, "body": "b"}\n')
    with pytest.raises(ValueError, match="bad line"):
        jsonl.read_strict(spark, str(path), contract.ENQUIRY)
    path.write_text("\n".join(json.dumps(g) for g in good + good[:1]))
    with pytest.raises(ValueError, match="duplicate id"):
        jsonl.read_strict(spark, str(path), contract.ENQUIRY)


def test_queue_sink_and_open_scan_keep_unknown_fields(spark, rows, tmp_path):
    path = str(tmp_path / "q")
    frame = rows([("b", 0.5, None, {"k": 1}), ("a", 0.25, None, {"k": 2})],
                 "record_id STRING, confidence DOUBLE, decision STRING, extra MAP<STRING, INT>")
    jsonl.write_json(frame, path)
    lines = spark.read.text(path)
    assert [json.loads(r.value)["record_id"] for r in lines.collect()] == ["a", "b"]
    queue = jsonl.read_queue(lines)
    log = rows([("a", "accept", None, 1)], "record_id STRING, decision STRING, reviewer_text STRING, ts INT")
    after = review.apply_decisions(queue, review.first_decisions(log, queue))
    raw = {r.record_id: json.loads(r.raw) for r in after.collect()}
    assert raw["a"]["decision"] == "accept" and raw["a"]["extra"] == {"k": 2}
    assert raw["b"]["decision"] is None and raw["a"]["confidence"] == 0.25


def test_file_fingerprints_and_drift(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_text(name)
    before = fingerprint.file_fingerprints(spark, str(tmp_path)).collect()
    manifest = spark.createDataFrame(before)
    (tmp_path / "b").write_text("changed")
    os.remove(tmp_path / "c")
    (tmp_path / "d").write_text("new")
    now = fingerprint.file_fingerprints(spark, str(tmp_path))
    got = {r.name[-1]: r.status for r in fingerprint.drift(now, manifest, ["name"]).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "removed", "d": "added"}


def test_table_fingerprint_ignores_row_order(rows):
    a = rows([(1, "x"), (2, None), (2, None)], "k INT, v STRING")
    b = rows([(2, None), (1, "x"), (2, None)], "k INT, v STRING")
    c = rows([(2, None), (1, "x"), (2, "")], "k INT, v STRING")
    prints = [fingerprint.table_fingerprints(f, [], ["k", "v"]).collect() for f in (a, b, c)]
    assert prints[0] == prints[1] != prints[2]


def test_last_writer_wins(rows):
    old = rows([("a", 1), ("b", 1)], "id STRING, v INT")
    new = rows([("b", 2), ("c", 2)], "id STRING, v INT")
    got = {r.id: r.v for r in merge.merge_by_key(old, new, ["id"]).collect()}
    assert got == {"a": 1, "b": 2, "c": 2}


def test_halves_must_not_share_labels(rows):
    with pytest.raises(ValueError):
        jsonl.split_halves(rows([("a", "b", "c")], "record_id STRING, x STRING, y STRING"), ["x"], ["x"])


def test_prices_keep_half_filled_entries(rows):
    doc = json.dumps({"_note": "x", "prices": {"m": {"input_per_mtok": 0.2, "output_per_mtok": 0.8},
                                               "n": {"input_per_mtok": 2.0}}})
    got = {r.model: (r.input_per_mtok, r.output_per_mtok)
           for r in dimensions.price_rows(rows([(doc,)], "value STRING")).collect()}
    assert got == {"m": (0.2, 0.8), "n": (2.0, None)}


def test_untrusted_and_future_sources(rows):
    data = [("a", "https://www.ia.org.hk/x", "2024-01-01"), ("b", "https://evil.org/www.ia.org.hk", "2024-01-01"),
            ("c", "https://www.icb.org.hk/", "2025-01-01"), ("c", "https://www.icb.org.hk/", "2024-01-01")]
    frame = rows(data, "id STRING, url STRING, verified_on STRING")
    got = {(r.key, r.rule) for r in dimensions.source_violations(frame, "2024-06-01").collect()}
    assert got == {("b", "untrusted host"), ("c", "future review date"), ("c", "duplicate id")}


# ---- review ----------------------------------------------------------------------------------
def test_first_valid_decision_wins_and_decided_items_stay(rows):
    queue = rows([("a", "draft", None, None), ("b", "draft", None, None), ("c", "draft", "accept", None)],
                 "record_id STRING, draft_reply STRING, decision STRING, reviewer_text STRING")
    log = rows([("a", "edit", " draft ", 1), ("a", "edit", "better", 2), ("a", "discard", None, 3),
                ("b", "what", None, 1), ("c", "discard", None, 1), ("a", "accept", "kept?", 0)],
               "record_id STRING, decision STRING, reviewer_text STRING, ts INT")
    first = review.first_decisions(log.filter("ts > 0"), queue)
    state = {r.record_id: (r.decision, r.reviewer_text)
             for r in review.apply_decisions(queue, first).collect()}
    assert state == {"a": ("edit", "better"), "b": (None, None), "c": ("accept", None)}
    accepted = review.first_decisions(log, queue).collect()
    assert [(r.decision, r.reviewer_text) for r in accepted] == [("accept", None)]


def test_ids_of_ten_digits_stay_apart(spark, rows):
    from gradewright.operators import sample
    from gradewright.plans import views
    numbers = [7, 123456789, 999999999, 1234567890, 1234567891, 10 ** 15]
    frame = rows([(n,) for n in numbers], "n LONG")
    padded = [r.p for r in frame.selectExpr(f"{views.padded('n')} AS p").collect()]
    assert padded == [f"{n:09d}" for n in numbers]
    offset = 999_999_998  # positions past nine digits, as in a table of over 10**9 rows
    ids = [r.i for r in rows([(k,) for k in range(1, 6)], "position LONG").select(
        sample.padded_id("BR-", F.col("position") + offset).alias("i")).collect()]
    assert ids == [f"BR-{offset + k:09d}" for k in range(1, 6)] and len(set(ids)) == 5


def test_padding_reads_the_same_in_sql():
    import duckdb
    from gradewright.plans import views
    for n in (1, 999999999, 1234567890):
        assert duckdb.sql(f"SELECT {views.padded(str(n))}").fetchall() == [(f"{n:09d}",)]


def test_last_writer_wins(rows):
    old = rows([(1, "a"), (2, "b")], "id INT, v STRING")
    new = rows([(2, "x", 1), (2, "y", 3), (2, "z", 2), (3, "n", 1)], "id INT, v STRING, turn INT")
    got = {(r.id, r.v) for r in merge.merge_by_key(old, new, ["id"], ["turn"]).collect()}
    assert got == {(1, "a"), (2, "y"), (3, "n")}


def test_repeated_scores_are_reported_and_do_not_lift(rows):
    from gradewright.operators import gate
    scores = rows([("c", "m", 0.9), ("c", "m", 0.2), ("c", "k", None)], "combination STRING, metric STRING, value DOUBLE")
    assert [tuple(r) for r in gate.duplicate_scores(scores).collect()] == [("c", "m", 2)]
    assert gate.score_map(scores).first()["_scores"] == {"m": 0.2, "k": None}


def test_required_n_is_taken_at_the_overall_accuracy(rows):
    from gradewright.operators import calibrate
    pairs = rows([(0.95, i < 81) for i in range(90)] + [(0.55, i < 9) for i in range(10)], "confidence DOUBLE, correct BOOLEAN")
    got = calibrate.calibration_intervals(calibrate.calibration_table(pairs)).collect()
    assert {r.required_n for r in got} == {139} and len(got) == 2


def test_cell_verdicts_leave_unmeasured_metrics_null(rows):
    from gradewright import fixed
    from gradewright.operators import gate
    cells = rows([("good", 1.0, 0.0), ("slow", 1.0, 0.03), ("bad", 0.5, 0.0), ("none", None, 0.0)],
                 "cell STRING, v DOUBLE, rate DOUBLE")
    every = {*fixed.HARD_BARS, *fixed.TRIAGE_WEIGHTS, *fixed.DRAFT_WEIGHTS["recorded"]}
    got = {r.cell: r for r in gate.cell_verdicts(cells, {m: F.col("v") for m in every}, F.col("rate"), ["cell"]).collect()}
    assert (got["good"].verdict, round(got["good"].published, 9), got["good"].missed) == ("PASS", 1.0, [])
    assert (got["slow"].verdict, got["slow"].missed, got["slow"].published) == ("DISQUALIFIED", ["schema failure rate"], None)
    assert got["bad"].breaches == len(fixed.HARD_BARS)
    assert (got["none"].verdict, got["none"].diagnostic) == ("PASS", None)


def test_folder_fingerprints_do_not_depend_on_file_names(spark, tmp_path):
    for root, names in (("now", "ab"), ("then", "yx")):
        for folder in ("p=1", "p=2"):
            (tmp_path / root / folder).mkdir(parents=True)
            for text, name in zip(("one", folder), names):
                (tmp_path / root / folder / name).write_text(text)
    (tmp_path / "then" / "p=2" / "z").write_text("more")
    now, then = (fingerprint.folder_fingerprints(spark, str(tmp_path / r)) for r in ("now", "then"))
    assert {(r.name, r.n) for r in then.collect()} == {("p=1", 2), ("p=2", 3)}
    got = {r.name: r.status for r in fingerprint.drift(now, then, ["name"]).collect()}
    assert got == {"p=1": "unchanged", "p=2": "changed"}


@pytest.mark.parametrize("raw, bad", [
    ("7", False), ("null", False), ("0", False), ("10", False), ("11", True), ("-1", True), ("true", True),
    ('"7"', True), ("7.5", True), ("[7]", True), ("{}", True)])
def test_json_labels_must_be_integers(rows, raw, bad):
    lines = rows([(f'{{"record_id": "r", "metric": "tone match", "human": {raw}}}',)], "value STRING")
    found = validate.label_violations(validate.label_lines(lines), kind="kind").collect()
    assert [(r.key, r.rule) for r in found] == ([("r|tone match", "not an integer 0-10")] if bad else [])


def test_json_labels_without_score_or_json(rows):
    lines = rows([('{"record_id": "r", "metric": "tone match"}',), ("nonsense",), (None,)], "value STRING")
    got = validate.label_lines(lines)
    assert [r.kind for r in got.collect()] == ["MISSING", "BROKEN", "BROKEN"]
    rules = [r.rule for r in validate.label_violations(got, kind="kind").collect()]
    assert rules.count("not an integer 0-10") == 3


def test_review_counts(rows):
    queue = rows([("a", None, "d"), ("b", None, "d"), ("c", None, "d"), ("e", None, "d"), ("f", "accept", "d")],
                 "record_id STRING, decision STRING, draft_reply STRING")
    log = rows([("a", "edit", " d ", 1), ("a", "accept", None, 2), ("a", "discard", None, 3), ("b", "skip", None, 1),
                ("c", "skip", None, 1), ("c", "edit", "new", 2), ("f", "discard", None, 1), ("x", "accept", None, 1)],
               "record_id STRING, decision STRING, reviewer_text STRING, ts INT")
    got = {r.outcome: r.n for r in review.review_counts(queue, log).collect()}
    assert got == {"accept": 1, "edit": 1, "pending": 2, "skipped": 1}
    none = review.review_counts(queue.filter("false"), log).collect()
    assert [tuple(r) for r in none] == [("skipped", 0)]


def test_subset_compares_digests(rows):
    schema = "id INT, text STRING, lang STRING"
    source = rows([(1, "t", None), (2, "t", "null"), (3, None, "t"), (4, "a", "b")], schema)
    copy = rows([(1, "t", None), (2, "t", None), (3, "t", None), (4, "a", "b")], schema)
    subset = copy.withColumn("ord", F.col("id")).withColumn("declared", F.col("id"))
    found = validate.subset_violations(subset, source, source, ["text", "lang"], "id").collect()
    assert {(r.key, r.rule) for r in found} == {("2", "not verbatim"), ("3", "not verbatim")}
