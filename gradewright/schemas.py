"""Explicit schemas of the tables the jobs read and write; nothing is inferred."""

from pyspark.sql import types as T

_strings = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


S, D, I, L, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()

TOKENS = T.ArrayType(_struct(token=S, logprob=D))

ENQUIRIES = _struct(id=S, subject=S, body=S)
GOLDEN = _struct(
    id=S, expected_type=S, expected_priority=S, acceptable_types=_strings, tags=_strings,
    must_include=_strings, must_not_assert=_strings, label_note=S,
)
RESPONSES = _struct(
    run_id=S, record_id=S, stage=S, model=S, attempt=I, raw=S, temperature=D, is_vote=B,
    logprobs=TOKENS, prompt_tokens=L, completion_tokens=L, reasoning_tokens=L, seconds=D,
    provider_error=S, ts=T.TimestampType(),
)
OUTPUTS = _struct(
    run_id=S, record_id=S, triage_model=S, draft_model=S, case_type=S, priority=S,
    confidence=D, confidence_method=S, summary=S, draft_reply=S, evidence_ids=_strings,
)
TRACES = _struct(
    record_id=S, stage=S, model=S, thinking=B, attempts=L, prompt_tokens=L,
    completion_tokens=L, reasoning_tokens=L, seconds=D, confidence_method=S,
    confidence_detail=S, extra_calls=L, prompt=S, response=S, raw_failures=_strings,
)
QUEUE = _struct(
    record_id=S, case_type=S, priority=S, confidence=D, summary=S, draft_reply=S,
    decision=S, reviewer_text=S,
)
DECISIONS = _struct(record_id=S, decision=S, reviewer_text=S, ts=T.TimestampType())
JUDGE_SCORES = _struct(
    combination=S, record_id=S, metric=S, score=D, reason=S, error=S, attempt=I,
    has_logprobs=B,
)
HUMAN_LABELS = _struct(record_id=S, metric=S, human=I)
PRICES = T.MapType(S, _struct(input_per_mtok=D, output_per_mtok=D))
