"""Strict JSON contracts as Column expressions.

A contract is a list of fields. ``parse`` turns a raw string into a struct
``(valid, reason, <field> ...)`` without a UDF:

* one markdown code fence is unwrapped, nothing else is repaired;
* the text must be exactly one JSON object. The variant parser ignores trailing
  text, so the text is parsed inside ``[...]`` (needs exactly one element) and,
  when it holds a ``]`` that could close that bracket early, inside ``{"v":...}`` too;
* keys must be exactly the declared ones, types are strict (a boolean or a
  string is never a number), values in range.

A repeated key is rejected, because the variant parser refuses it. This is
stricter than keeping the last value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .columns import lits


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # string | number | integer | strings
    allowed: tuple[str, ...] | None = None
    low: float | None = None
    high: float | None = None
    min_length: int = 0
    pattern: str | None = None
    required: bool = True
    nullable: bool = False


TRIAGE_DECISION = (
    Field("case_type", "string", allowed=fixed.CASE_TYPES),
    Field("priority", "string", allowed=fixed.PRIORITIES),
)
TRIAGE_OUTPUT = TRIAGE_DECISION + (Field("confidence", "number", low=0.0, high=1.0),)
DRAFT_OUTPUT = (
    Field("summary", "string", min_length=1),
    Field("draft_reply", "string", min_length=1),
)
ENQUIRY = (
    Field("id", "string", pattern=fixed.RECORD_ID),
    Field("subject", "string", min_length=1),
    Field("body", "string", min_length=1),
)
GOLDEN_LABEL = (
    Field("id", "string", pattern=fixed.RECORD_ID),
    Field("expected_type", "string", allowed=fixed.CASE_TYPES),
    Field("expected_priority", "string", allowed=fixed.PRIORITIES),
    Field("acceptable_types", "strings", allowed=fixed.CASE_TYPES, required=False),
    Field("tags", "strings", allowed=fixed.TAGS, required=False),
    Field("must_include", "strings", required=False),
    Field("must_not_assert", "strings", required=False),
    Field("label_note", "string", required=False, nullable=True),
)

_SPARK_TYPE = {"string": "string", "number": "double", "integer": "bigint",
               "strings": "array<string>"}


def unwrap(raw: Column) -> Column:
    """Content of a single code fence around the whole text, else the text."""
    return F.when(raw.rlike(fixed.FENCE), F.regexp_extract(raw, fixed.FENCE, 1)).otherwise(raw)


_SHAPE = {
    "string": "STRING",
    "number": r"(?:BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))",
    "integer": "BIGINT",
    "strings": "ARRAY<(?:STRING|VOID)>",
}


def _type_pattern(field: Field) -> str:
    kind = _SHAPE[field.kind]
    return f"(?:{kind}|VOID)" if field.nullable else kind


def _shape_pattern(spec: tuple[Field, ...]) -> str:
    """Regex over the parsed type text: exactly the declared keys, each of its type.

    The type text lists keys in sorted order, so one match checks key set and
    types together. Optional keys may be absent.
    """
    body = ""
    for index, field in enumerate(sorted(spec, key=lambda f: f.name)):
        entry = f"{field.name}: {_type_pattern(field)}(?:, |(?=>))"
        body += entry if field.required else f"(?:{entry})?"
    return f"^ARRAY<OBJECT<{body}>>$"


def _shape_defect(spec: tuple[Field, ...], shape: Column, text: Column) -> Column:
    """Why a parsed object does not have the declared keys and types."""
    extra = F.size(F.array_except(F.json_object_keys(text), lits([f.name for f in spec]))) > 0
    out = F.when(extra, F.lit("unexpected field"))
    for field in spec:
        key = rf"(?:<|, ){field.name}: "
        if field.required:
            out = out.when(~shape.rlike(key), F.lit(f"{field.name}: missing"))
        out = out.when(shape.rlike(key) & ~shape.rlike(key + _type_pattern(field) + "[,>]"),
                       F.lit(f"{field.name}: wrong type"))
    return out.otherwise(F.lit("wrong shape"))


def _value_defect(field: Field, value: Column) -> Column | None:
    """Reason a well-typed value is refused, NULL when it is fine."""
    checks: list[tuple[Column, str]] = []
    if field.kind == "strings":
        if field.allowed is not None:
            checks.append((F.size(F.array_except(value, lits(field.allowed))) > 0, "not allowed"))
    elif field.allowed is not None:
        checks.append((~value.isin(*field.allowed), "not allowed"))
    if field.low is not None:
        checks.append((value < field.low, "out of range"))
    if field.high is not None:
        checks.append((value > field.high, "out of range"))
    if field.min_length:
        checks.append((F.length(value) < field.min_length, "too short"))
    if field.pattern is not None:
        checks.append((~value.rlike(field.pattern), "bad format"))
    out = None
    for broken, why in checks:
        text = F.lit(f"{field.name}: {why}")
        out = F.when(broken, text) if out is None else out.when(broken, text)
    return out


def parse(df, raw: str, contract: tuple[Field, ...]):
    """Add ``valid``, ``reason`` and one typed column per contract field."""
    return parse_by(df, raw, F.lit(""), {"": contract})


def parse_by(df, raw: str, stage: Column, contracts: dict[str, tuple[Field, ...]]):
    """Validate each row against the contract of its stage, in one pass over the log.

    Typed columns are NULL on rows that do not validate, so an invalid response
    can never leak a half-read value. Each step is its own projection, so the
    text is parsed once and the steps stay small enough to compile. A row of an
    undeclared stage is invalid.
    """
    text, node, shape = F.col("_text"), F.col("_node"), F.col("_shape")
    here = {name: stage == name for name in contracts}
    staged = (df.withColumn("_text", unwrap(F.col(raw)))
              .withColumn("_node", F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))
              .withColumn("_shape", F.schema_of_variant(node))
              .withColumns({f"_v{i}_{f.name}": F.when(here[name], F.try_variant_get(
                  node, f"$[0].{f.name}", _SPARK_TYPE[f.kind]))
                  for i, (name, spec) in enumerate(contracts.items()) for f in spec}))
    closed_early = F.contains(text, F.lit("]")) & F.try_parse_json(
        F.concat(F.lit('{"v":'), text, F.lit("}"))).isNull()
    nothing = F.lit(None).cast("string")
    detail = None
    for i, (name, spec) in enumerate(contracts.items()):
        checks = [c for c in (_value_defect(f, F.col(f"_v{i}_{f.name}")) for f in spec)
                  if c is not None]
        found = F.when(~shape.rlike(_shape_pattern(spec)),
                       _shape_defect(spec, shape, text)).otherwise(F.coalesce(*checks, nothing))
        detail = F.when(here[name], found) if detail is None else detail.when(here[name], found)
    reason = (
        F.when(F.col(raw).isNull(), F.lit("response is missing"))
        .when(shape.isNull() | (shape == "ARRAY<VOID>") | closed_early,
              F.lit("response is not JSON"))
        .when(F.variant_get(node, "$[1]", "variant").isNotNull(), F.lit("response is not JSON"))
        .when(~shape.startswith("ARRAY<OBJECT<"), F.lit("response is not an object"))
        .otherwise(detail.otherwise(F.lit("no contract for this stage")))
    )
    staged = staged.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    sources: dict[str, list[Column]] = {}
    for i, spec in enumerate(contracts.values()):
        for f in spec:
            sources.setdefault(f.name, []).append(F.col(f"_v{i}_{f.name}"))
    typed = [F.when(ok, F.coalesce(*cols)).alias(n) for n, cols in sources.items()]
    keep = [c for c in df.columns if c not in sources]
    # The one-element inline keeps a later filter on ``valid`` above this point:
    # pushed down, it would repeat the whole parse inside the predicate.
    return staged.select(*keep, F.inline(F.array(F.struct(
        ok.alias("valid"), F.col("reason"), *typed))))
