"""Strict contracts, retries and failure counts."""

import json

import pytest

from gradewright.functions import contract
from gradewright.operators import responses


def parsed(rows, texts, spec):
    frame = rows([(i, t) for i, t in enumerate(texts)], "i INT, raw STRING")
    return [r for r in contract.parse(frame, "raw", spec).orderBy("i").collect()]


GOOD = '{"case_type": "CLAIM", "priority": "LOW", "confidence": %s}'


@pytest.mark.parametrize("value", ["0", "1", "0.5", "1.0", "1e-3", "0.9999999999999999999"])
def test_numbers_in_range_are_accepted(rows, value):
    row, = parsed(rows, [GOOD % value], contract.TRIAGE_OUTPUT)
    assert row.valid and row.confidence == pytest.approx(float(value))


def test_confidence_must_be_a_number_in_range(rows):
    bad = ["true", '"0.9"', "NaN", "Infinity", "1.01", "-0.1", "null", "[0.5]", "{}"]
    assert not any(r.valid for r in parsed(rows, [GOOD % v for v in bad], contract.TRIAGE_OUTPUT))


def test_malformed_texts_are_rejected(rows):
    ok = '{"case_type": "CLAIM", "priority": "LOW"}'
    bad = [
        "", "   ", "no json", ok[:-1], ok + " x", ok + ok, "[" + ok + "]", ok + "], [1",
        ok + '}, "z": {"a": 1', '"CLAIM"', "null", "3", "[]", "{}",
        '{"case_type": "CLAIM", "priority": "LOW",}', "{'case_type': 'CLAIM'}",
        '{"case_type": "CLAIM"}', '{"case_type": "claim", "priority": "LOW"}',
        '{"case_type": "CLAIM", "priority": "LOW", "extra": 1}',
        '{"case_type": 1, "priority": "LOW"}', '{"case_type": {"case_type": "CLAIM"}, "priority": "LOW"}',
        'Sure: ' + ok, "```json\n" + ok,
    ]
    got = parsed(rows, bad, contract.TRIAGE_DECISION)
    assert [r.raw for r in got if r.valid] == []
    assert all(r.reason for r in got)


def test_one_code_fence_is_unwrapped(rows):
    ok = '{"case_type": "CLAIM", "priority": "LOW"}'
    texts = [ok, f"```json\n{ok}\n```", f"```\n{ok}```", f"  ```json {ok} ```  ", f" {ok}\n"]
    assert all(r.valid for r in parsed(rows, texts, contract.TRIAGE_DECISION))


def test_draft_needs_two_non_empty_strings(rows):
    texts = [json.dumps({"summary": s, "draft_reply": d}) for s, d in
             [("a", "b"), ("", "b"), ("a", ""), (1, "b"), ("a", None), ("é]", "x]y")]]
    assert [r.valid for r in parsed(rows, texts, contract.DRAFT_OUTPUT)] == [
        True, False, False, False, False, True]


def test_golden_label_optional_fields(rows):
    base = {"id": "ENQ-001", "expected_type": "CLAIM", "expected_priority": "LOW"}
    texts = [json.dumps({**base, **extra}) for extra in [
        {}, {"tags": ["REFUSAL"], "label_note": None}, {"tags": []}, {"tags": ["NOPE"]},
        {"tags": "REFUSAL"}, {"acceptable_types": ["CLAIM", 3]}, {"label_note": 5},
        {"id": "ENQ-1"}]]
    assert [r.valid for r in parsed(rows, texts, contract.GOLDEN_LABEL)] == [
        True, True, True, False, False, False, False, False]


def test_invalid_rows_carry_no_values(rows):
    row, = parsed(rows, ['{"case_type": "CLAIM", "priority": "??"}'], contract.TRIAGE_DECISION)
    assert (row.case_type, row.priority) == (None, None)


ATTEMPTS = "run_id STRING, record_id STRING, stage STRING, attempt INT, valid BOOLEAN, reason STRING, provider_error STRING, v STRING"


def call(record, *outcomes):
    out = []
    for i, o in enumerate(outcomes, start=1):
        out.append(("r", record, "triage", i, o == "ok", None if o == "ok" else f"why {i}",
                    "down" if o == "refused" else None, f"v{i}" if o == "ok" else None))
    return out


def test_retry_outcomes(rows):
    data = (call("a", "bad", "bad", "ok") + call("b", "bad", "bad", "bad", "ok")
            + call("c", "ok", "bad") + call("d", "bad", "refused", "ok") + call("e", "bad"))
    got = {r.record_id: r for r in responses.resolve_retries(rows(data, ATTEMPTS), payload=["v"])
           .collect()}
    seen = {k: (r.outcome, r.attempt, r.failed_attempts, r.v) for k, r in got.items()}
    assert seen == {
        "a": ("ok", 3, 2, "v3"), "b": ("exhausted", None, 3, None), "c": ("ok", 1, 0, "v1"),
        "d": ("provider_error", 2, 1, None), "e": ("open", None, 1, None)}
    counts, = responses.failure_counts(
        responses.resolve_retries(rows(data, ATTEMPTS))).collect()
    assert (counts.schema_failures, counts.retry_exhaustions, counts.provider_refusals) == (7, 1, 1)


def test_failure_is_handed_to_the_next_attempt(rows):
    got = responses.retry_notes(rows(call("a", "bad", "bad", "ok"), ATTEMPTS)).orderBy("attempt")
    assert [r.previous_failure for r in got.collect()] == [None, "why 1", "why 2"]


def test_failure_rate_has_a_floor_of_one_call(rows):
    resolved = rows([("draft", 1, "ok")], "stage STRING, failed_attempts INT, outcome STRING")
    assert responses.schema_failure_rate(resolved).collect()[0].schema_failure_rate == 1.0


def test_only_a_missing_score_is_retried(rows):
    log = rows([("c", "a", "m", 1, None, "missing score"), ("c", "a", "m", 2, 0.5, None),
                ("c", "b", "m", 1, None, "timeout"), ("c", "b", "m", 2, 0.9, None),
                ("c", "d", "m", 1, 0.1, None)],
               "combination STRING, record_id STRING, metric STRING, attempt INT, score DOUBLE, error STRING")
    got = {r.record_id: (r.score, r.error, r.retries)
           for r in responses.retryable_ratings(log).collect()}
    assert got == {"a": (0.5, None, 1), "b": (None, "timeout", 0), "d": (0.1, None, 0)}
