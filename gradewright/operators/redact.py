"""Identifier detection, pseudonymisation and encryption at rest."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions import spans
from ..functions.columns import seeded, strip


def find_entities(texts: DataFrame, text: str, entities: Sequence[str] | None = None,
                  recognizers: Sequence[spans.Recognizer] = fixed.RECOGNIZERS,
                  out: str = "spans") -> DataFrame:
    """Add the array of all entity spans of a text column."""
    chosen = recognizers if entities is None else spans.recognizers_for(entities, recognizers)
    return texts.withColumn(out, spans.find(F.col(text), chosen))


def merged_spans(texts: DataFrame, text: str, entities: Sequence[str] = fixed.PSEUDONYMISED,
                 out: str = "spans") -> DataFrame:
    """Spans merged to cover every detected character (coverage, not identity)."""
    found = find_entities(texts, text, entities, out=out)
    return found.withColumn(out, spans.merge_cover(F.col(out)))


def winning_spans(texts: DataFrame, text: str, entities: Sequence[str] = fixed.CHECKED,
                  out: str = "spans") -> DataFrame:
    """One best span per place (identity, not coverage)."""
    found = find_entities(texts, text, entities, out=out)
    return found.withColumn(out, spans.pick_winners(F.col(out)))


def fake(entity: Column, original: Column, salt: Column) -> Column:
    """Deterministic replacement: the same value in the same record always maps alike."""
    def salted(letter: str) -> Column:
        return F.concat(salt, F.lit(letter))

    def number(letter: str, modulus: int) -> Column:
        return seeded(original, salted(letter), modulus)

    head = F.regexp_extract(original, "^[A-Z]{1,4}", 0)
    prefix = F.when(head == "", "HK").otherwise(head)
    return (
        F.when(entity == "PHONE_NUMBER", F.format_string("9%07d", number("p", 10_000_000)))
        .when(entity == "EMAIL_ADDRESS", F.concat(
            F.lit("customer"), (number("e", 9000) + 1000).cast("string"), F.lit("@example.com")))
        .when(entity == "HK_ID", F.format_string("X%06d(A)", number("h", 1_000_000)))
        .when(entity == "POLICY_NUMBER", F.concat(
            prefix, F.lit("-"), (number("n", 90_000_000) + 10_000_000).cast("string")))
        .otherwise(original))


def _covered_texts(text: Column) -> Column:
    """Array of (entity, original) for the merged spans of one text, in reading order."""
    merged = spans.merge_cover(spans.find(text, spans.recognizers_for(fixed.PSEUDONYMISED)))
    return F.transform(merged, lambda s: F.struct(
        s["entity"].alias("entity"),
        strip(F.substring(text, s["start"] + 1, s["end"] - s["start"])).alias("original")))


def pseudonymise(records: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Replace identifiers consistently over all text fields of a row.

    Adds ``mapping`` (ARRAY<STRUCT<original, replacement>>) and rewrites the
    fields. The first field that shows a value decides its label. Longer
    originals are replaced first, so an identifier inside another one is safe;
    values under 3 characters stay.
    """
    staged = records.withColumn("_seen", F.filter(
        F.flatten(F.array(*[F.coalesce(_covered_texts(F.col(f)), F.array()) for f in fields])),
        lambda e: F.length(e["original"]) >= 3))
    # The earliest mention of every original, found by sorting and not by looking back.
    placed = F.array_sort(F.transform("_seen", lambda e, i: F.struct(
        e["original"].alias("original"), i.alias("place"), e["entity"].alias("entity"))))
    staged = staged.withColumn("_placed", placed).withColumn("_first", F.array_sort(F.filter(
        F.transform("_placed", lambda e, i: F.when((i == 0) | (F.get("_placed", i - 1)["original"] != e["original"]),
                    F.struct(e["place"].alias("place"), e["original"].alias("original"), e["entity"].alias("entity")))),
        lambda e: e.isNotNull())))
    staged = staged.withColumn("mapping", F.transform("_first", lambda e: F.struct(
        e["original"].alias("original"),
        fake(e["entity"], e["original"], F.col(key)).alias("replacement"))))
    staged = staged.withColumn("_order", F.array_sort(
        "mapping", lambda a, b: F.length(b["original"]) - F.length(a["original"])))
    return staged.withColumns({f: F.aggregate(
        F.col("_order"), F.col(f),
        lambda acc, e: F.replace(acc, e["original"], e["replacement"])) for f in fields}
    ).drop("_seen", "_placed", "_first", "_order")


def review_flags(records: DataFrame, fields: Sequence[str],
                 entities: Sequence[str] = fixed.REVIEWED) -> DataFrame:
    """Names found in any field, sorted and distinct: reported, never rewritten."""
    chosen = spans.recognizers_for(entities)
    found = F.flatten(F.array(*[
        F.transform(F.coalesce(spans.find(F.col(f), chosen), F.array()),
                    lambda s: strip(s["text"])) for f in fields]))
    return records.withColumn("for_review", F.array_sort(F.array_distinct(
        F.filter(found, lambda x: F.length(x) >= 3))))


# ---- encryption at rest ---------------------------------------------------------------
class MissingTraceKey(RuntimeError):
    """No usable key: traces are not written rather than written in the clear."""


def trace_key(value: str | None = None) -> str:
    """The key from the argument or the environment, checked for a legal length."""
    key = value if value is not None else os.environ.get(fixed.TRACE_KEY_ENV, "")
    if len(key) not in fixed.TRACE_KEY_LENGTHS:
        raise MissingTraceKey(
            f"{fixed.TRACE_KEY_ENV} must have one of {fixed.TRACE_KEY_LENGTHS} characters")
    return key


def sensitive_columns(frame: DataFrame,
                      plain: Sequence[str] = fixed.TRACE_PLAIN) -> list[T.StructField]:
    """Every column not on the allow-list; a new column is covered without being listed."""
    return [f for f in frame.schema.fields if f.name not in plain]


def _each_text(field: T.StructField, apply) -> Column:
    c = F.col(field.name)
    if isinstance(field.dataType, T.StringType):
        return apply(c)
    if isinstance(field.dataType, T.ArrayType) and isinstance(
            field.dataType.elementType, T.StringType):
        return F.transform(c, apply)
    raise TypeError(f"column {field.name} is not text: classify it as plain or drop it")


def encrypt(frame: DataFrame, key: str | None = None,
            plain: Sequence[str] = fixed.TRACE_PLAIN) -> DataFrame:
    """Encrypt every sensitive column whole (arrays per element); empty text stays empty."""
    secret = F.lit(trace_key(key))

    def lock(c: Column) -> Column:
        return F.when(c == "", c).otherwise(
            F.base64(F.aes_encrypt(c.cast("binary"), secret, F.lit("CBC"))))

    return frame.withColumns({f.name: _each_text(f, lock) for f in sensitive_columns(frame, plain)})


def decrypt(frame: DataFrame, key: str | None = None,
            plain: Sequence[str] = fixed.TRACE_PLAIN) -> DataFrame:
    """Reverse of ``encrypt`` for someone who holds the key."""
    secret = F.lit(trace_key(key))

    def unlock(c: Column) -> Column:
        return F.when(c == "", c).otherwise(
            F.aes_decrypt(F.unbase64(c), secret, F.lit("CBC")).cast("string"))

    return frame.withColumns(
        {f.name: _each_text(f, unlock) for f in sensitive_columns(frame, plain)})
