"""Hand-computed values for calibration, agreement, latency and confidence."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from gradewright.functions import banding
from gradewright.functions.logprob import with_label_probability
from gradewright.functions.ordered import from_ordered_bits, ordered_bits
from gradewright.operators import agree, calibrate, classify, confidence, ops


def one(frame):
    row, = frame.collect()
    return row


def test_wilson_of_three_in_three(rows):
    low, high = banding.wilson(F.col("h"), F.col("n"))
    row = one(rows([(3, 3)], "h INT, n INT").select(low.alias("l"), high.alias("u")))
    assert row.u == 1.0 and row.l < 0.5


def test_wilson_of_nothing_is_null(rows):
    low, high = banding.wilson(F.col("h"), F.col("n"))
    row = one(rows([(0, 0)], "h INT, n INT").select(low.alias("l"), high.alias("u")))
    assert row.l is None and row.u is None


def test_required_sample_size(rows):
    assert one(rows([(0.9,)], "p DOUBLE").select(banding.required_n(F.col("p")).alias("n"))).n == 139


PAIRS = "confidence DOUBLE, correct BOOLEAN"


def test_calibration_error_of_overconfidence(rows):
    pairs = rows([(0.95, i < 5) for i in range(10)], PAIRS)
    row = one(calibrate.calibration_error(calibrate.calibration_table(pairs)))
    assert row.ece == pytest.approx(0.45)


def test_calibration_weighs_buckets(rows):
    pairs = rows([(1.0, True)] * 20 + [(0.55, False)], PAIRS)
    row = one(calibrate.calibration_error(calibrate.calibration_table(pairs)))
    assert row.ece == pytest.approx(0.55 / 21)


def test_bucket_edges(rows):
    pairs = rows([(1.0, True), (0.22, True), (1.5, False), (0.6, True)], PAIRS)
    got = {r.low: r.n for r in calibrate.calibration_table(pairs).collect()}
    assert got == {0.9: 1, 0.0: 2, 0.6: 1}


def test_recorded_calibration_buckets(rows):
    # (low, n, hits, mean confidence) as published, ECE 0.45 by hand from one bucket.
    pairs = rows([(0.97, True)] * 35 + [(0.97, False)] + [(0.75, True)] * 2 + [(0.75, False)] * 2, PAIRS)
    row = one(calibrate.calibration_error(calibrate.calibration_table(pairs)))
    want = 36 / 40 * abs(35 / 36 - 0.97) + 4 / 40 * abs(0.5 - 0.75)
    assert row.ece == pytest.approx(want)


BANDS = "human_band INT, judge_band INT"


def _kappa(pairs):
    n = len(pairs)
    seen = sum((a - b) ** 2 for a, b in pairs) / n
    chance = sum((a - b) ** 2 for a, _ in pairs for _, b in pairs) / (n * n)
    return None if chance == 0 else 1 - seen / chance


@pytest.mark.parametrize("pairs", [
    [(0, 0), (1, 1), (2, 2), (3, 3)], [(0, 3), (3, 0), (1, 1), (2, 3), (2, 2)],
    [(0, 1), (1, 1), (1, 2), (3, 3), (3, 2), (0, 0)]])
def test_quadratic_kappa_against_the_definition(rows, pairs):
    row = one(agree.agreement(rows(pairs, BANDS)))
    assert row.kappa == pytest.approx(_kappa(pairs))
    assert row.n == len(pairs)


def test_agreement_without_variance_is_null(rows):
    row = one(agree.agreement(rows([(3, 3)] * 4, BANDS)))
    assert row.kappa is None and row.spearman is None and row.exact == 1.0


def test_spearman_needs_three_rows(rows):
    assert one(agree.agreement(rows([(0, 0), (3, 3)], BANDS))).spearman is None
    assert one(agree.agreement(rows([(0, 0), (1, 1), (3, 3)], BANDS))).spearman == pytest.approx(1.0)


def test_no_pairs_give_no_row(rows):
    assert agree.agreement(rows([(None, 1)], BANDS)).count() == 0


def test_bands_and_half_even_rounding(rows):
    cases = [("commitment groundedness", 0.25, 0), ("commitment groundedness", 0.35, 1),
             ("tone match", 0.35, 1), ("tone match", 0.25, 0), ("actionability", 0.85, 2),
             ("actionability", 0.86, 3), ("unknown", 0.5, None), ("actionability", 1.2, None)]
    frame = rows(cases, "metric STRING, score DOUBLE, want INT")
    got = frame.withColumn("band", banding.rater_band(F.col("score"), F.col("metric")))
    assert [r.band for r in got.collect()] == [c[2] for c in cases]


def test_cohen_kappa(rows):
    pairs = [("A", "A")] * 20 + [("A", "B")] * 5 + [("B", "A")] * 10 + [("B", "B")] * 15
    row = one(agree.cohen_kappa(rows(pairs, "expected STRING, predicted STRING"), ("A", "B")))
    assert row.kappa == pytest.approx(0.4)


def test_single_run_has_no_spread(rows):
    row = one(agree.spread(rows([(0.9,)], "k DOUBLE"), "k"))
    assert row.sd is None and row.mean == 0.9


def test_documented_disputes_are_not_outstanding(rows):
    data = [(r, "a", "CLAIM", "OTHER", ["CLAIM", "OTHER"], "LOW", "LOW") for r in (1, 2)]
    data += [(r, "b", "CLAIM", "OTHER", [], "LOW", "URGENT" if r == 1 else "LOW") for r in (1, 2)]
    frame = rows(data, "run_no INT, record_id STRING, planned_type STRING, opinion_type STRING, "
                       "acceptable_types ARRAY<STRING>, planned_priority STRING, opinion_priority STRING")
    got = {(r.record_id, r.field): (r.runs_contested, r.documented, r.outstanding)
           for r in agree.contested(frame, 2).collect()}
    assert got == {("a", "case_type"): (2, True, False), ("b", "case_type"): (2, False, True),
                   ("b", "priority"): (1, False, False)}


SECONDS = "k STRING, seconds DOUBLE"


def test_nearest_rank_p95(rows):
    row = one(ops.stage_latency(rows([("a", float(i)) for i in range(1, 21)], SECONDS), ["k"]))
    assert (row.n, row.median, row.p95) == (20, 10.5, 19.0)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 39, 40, 60, 61])
def test_exact_percentiles_against_sorting(rows, n):
    values = [((i * 7919) % 1009) / 97 for i in range(n)] + [0.25] * (n // 2)
    row = one(ops.stage_latency(rows([("a", v) for v in values], SECONDS), ["k"]))
    ordered = sorted(values)
    m = len(ordered)
    assert row.p95 == ordered[max(1, math.ceil(0.95 * m)) - 1]
    middle = (ordered[(m - 1) // 2] + ordered[m // 2]) / 2
    assert row.median == pytest.approx(middle)


def test_warmups_count_successes_not_positions(rows):
    data = [("r", "1", False), ("r", "2", True), ("r", "3", True), ("s", "1", True)]
    got = ops.drop_warmups(rows(data, "run_id STRING, record_id STRING, success BOOLEAN"), 1)
    assert [(r.run_id, r.record_id) for r in got.collect()] == [("r", "3")]


def test_missing_or_half_price_is_never_zero(rows):
    means = rows([("a", 10.0, 5.0), ("b", 10.0, 5.0), ("c", 10.0, 5.0)],
                 "model STRING, mean_prompt DOUBLE, mean_completion DOUBLE")
    prices = rows([("a", 2.0, 8.0), ("b", 2.0, None)],
                  "model STRING, input_per_mtok DOUBLE, output_per_mtok DOUBLE")
    got = {r.model: r.cost for r in ops.stage_cost(means, prices).collect()}
    assert got == {"a": pytest.approx(60 / 1e6), "b": None, "c": None}
    total = one(ops.end_to_end_cost(ops.stage_cost(means, prices), []))
    assert total.cost is None


TOKENS = "value STRING, logprobs ARRAY<STRUCT<token: STRING, logprob: DOUBLE>>"


def test_token_product(rows):
    tokens = [('{"', 0.0), ("case_type", 0.0), ('": "', 0.0), ("ADDRESS", math.log(0.7365)),
              ("_CHANGE", 0.0), ('"}', -0.5)]
    row = one(with_label_probability(rows([("ADDRESS_CHANGE", tokens)], TOKENS),
                                     "logprobs", "value", "case_type"))
    assert row.logprob_confidence == pytest.approx(0.7365)


def test_echoed_label_is_not_measured(rows):
    tokens = [("CLAIM or OTHER ", 0.0), ('"case_type": "', 0.0), ("CLAIM", math.log(0.55)), ('"', 0.0)]
    row = one(with_label_probability(rows([("CLAIM", tokens)], TOKENS), "logprobs", "value", "case_type"))
    assert row.logprob_confidence == pytest.approx(0.55)


def test_label_or_key_not_found(rows):
    data = [("CLAIM", [('"case_type": "OTHER"', 0.0)]), ("CLAIM", [("CLAIM", 0.0)]), ("CLAIM", []),
            ("CLAIM", None)]
    got = with_label_probability(rows(data, TOKENS), "logprobs", "value", "case_type").collect()
    assert [r.logprob_confidence for r in got] == [None] * 4


def test_votes_support_the_emitted_label(rows):
    emitted = rows([("a", "CLAIM"), ("b", "CLAIM"), ("c", "OTHER")], "record_id STRING, case_type STRING")
    votes = rows([("a", "CLAIM", True), ("a", "CLAIM", True), ("a", "OTHER", True),
                  ("b", "CLAIM", True), ("b", None, False), ("c", "CLAIM", True)],
                 "record_id STRING, case_type STRING, valid BOOLEAN")
    got = {r.record_id: r.vote_confidence
           for r in confidence.self_consistency(emitted, votes).collect()}
    assert got == {"a": pytest.approx(2 / 3), "b": None, "c": 0.0}


def test_shown_confidence_is_truncated(rows):
    row = one(rows([(0.9993,)], "c DOUBLE").select(banding.shown_confidence(F.col("c")).alias("s")))
    assert row.s == 0.999


def test_matrix_keeps_zero_cells_and_unknowns_apart(rows):
    pairs = rows([("A", "A"), ("A", "B"), ("Z", "A")], "expected STRING, predicted STRING")
    cells = {(r.expected, r.predicted): r.n
             for r in classify.confusion_matrix(pairs, ("A", "B", "C")).collect()}
    assert len(cells) == 9 and cells["A", "B"] == 1 and cells["C", "C"] == 0
    assert one(classify.unknown_labels(pairs, ("A", "B", "C"))).expected == "Z"
    report = classify.label_report(classify.confusion_matrix(pairs, ("A", "B", "C")))
    labels = {r.label: r for r in report.collect()}
    assert labels["A"].f1 == pytest.approx(2 / 3) and labels["C"].f1 == 0.0
    assert one(classify.macro_f1(report)).macro_f1 == pytest.approx(2 / 3)


def test_lenient_accuracy_always_credits_the_expected_label(rows):
    data = [("A", "A", []), ("A", "B", ["A", "B"]), ("A", "C", ["A", "B"]), ("A", "A", None)]
    frame = rows(data, "expected_type STRING, predicted_type STRING, acceptable_types ARRAY<STRING>")
    row = one(classify.accuracy_gap(frame))
    assert (row.strict, row.lenient, row.gap) == (0.5, 0.75, 0.25)


def test_critical_recall_without_support_is_null(rows):
    frame = rows([("LOW", "LOW")], "expected_priority STRING, predicted_priority STRING")
    assert one(classify.priority_scores(frame)).critical_recall is None


def test_schema_failure_rate_counts_attempts_not_missing_outputs(rows):
    """Failed attempts over two calls a record: a call that came right in the end still had its failures."""
    from gradewright.operators import responses
    log = [("a", "triage", 1, False, None), ("a", "triage", 2, False, None), ("a", "triage", 3, True, None),
           ("a", "draft", 1, False, None), ("a", "draft", 2, True, None), ("b", "triage", 1, False, "refused"),
           ("c", "triage", 1, True, None), ("c", "draft", 1, True, None)]
    frame = rows([("cell", *r) for r in log],
                 "cell STRING, record_id STRING, stage STRING, attempt INT, valid BOOLEAN, provider_error STRING")
    calls = responses.resolve_retries(frame, keys=["cell", "record_id", "stage"])
    row = one(responses.schema_failure_rate(calls, ["cell"]))
    assert (row.records, row.schema_failures, row.schema_failure_rate) == (3, 3, 0.5)


AWKWARD = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308,
           float("inf"), float("-inf"), 3.0, 0.1, -0.1, 1e-310, 1234.5678,
           *[2.0 ** e * f for e in (-1000, -30, 0, 31, 53, 900) for f in (1 - 2 ** -53, 1.0, 1 + 2 ** -52)]]


def test_ordered_bits_keep_order_and_every_bit(rows):
    frame = rows([(v,) for v in AWKWARD], "v DOUBLE")
    bits = F.col("bits")
    got = frame.select("v", ordered_bits(F.col("v")).alias("bits")).select(
        "v", "bits", from_ordered_bits(bits).alias("back")).collect()
    for r in got:
        assert r.back == r.v
        expected = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.bits == (-expected if r.v < 0 else expected), r.v
    assert [r.v for r in sorted(got, key=lambda r: r.bits)] == sorted(AWKWARD)


def test_percentiles_of_one_narrow_cell_and_of_a_wide_range(rows):
    close = [1e9 + i * 2 ** -20 for i in range(500)]
    wide = [(-1) ** i * 10.0 ** (i % 600 - 300) for i in range(500)]
    frame = rows([("close", v) for v in close] + [("wide", v) for v in wide] + [("wide", None)], SECONDS)
    got = {r.k: r for r in ops.stage_latency(frame, ["k"]).collect()}
    for name, values in (("close", close), ("wide", wide)):
        ordered = sorted(values)
        assert got[name].n == 500 and got[name].p95 == ordered[474]
        assert got[name].median == (ordered[249] + ordered[250]) / 2
    assert ops.stage_latency(frame.limit(0), ["k"]).count() == 0


def test_agreement_counts_what_it_leaves_out(rows):
    pairs = rows([("m", 0, 0), ("m", 3, 3), ("m", None, 1), ("m", 2, None), ("e", None, None)], f"k STRING, {BANDS}")
    got = {r.k: (r.n, r.errors, r.exact) for r in agree.agreement(pairs, ["k"], errors=True).collect()}
    assert got == {"m": (2, 2, 1.0), "e": (0, 1, None)}
    assert [r.k for r in agree.agreement(pairs, ["k"]).collect()] == ["m"]
