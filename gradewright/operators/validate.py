"""Record, set, label and plan checks. Each returns (key, rule, detail) violations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.banding import band_of
from ..functions.columns import strip, violations


def _has(tag: str) -> Column:
    return F.array_contains("tags", tag)


def _blank(name: str) -> Column:
    return F.length(strip(F.coalesce(F.col(name), F.lit("")))) == 0


def record_violations(records: DataFrame, key: str = "id", pattern: str = fixed.RECORD_ID
                      ) -> DataFrame:
    """Label and text rules of one record; arrays must be non-NULL (empty means none)."""
    ambiguous = F.size("acceptable_types") > 0
    unexplained = _blank("label_note")
    return violations(records, key, {
        "malformed id": ~F.coalesce(F.col(key).rlike(pattern), F.lit(False)),
        "blank subject": _blank("subject"),
        "blank body": _blank("body"),
        "subject too long": F.length(strip("subject")) > fixed.SUBJECT_MAX,
        "body too long": F.length(strip("body")) > fixed.BODY_MAX,
        "mixed topic lists no alternatives": _has("MIXED_TOPIC") & ~ambiguous,
        "expected type not acceptable":
            ambiguous & ~F.array_contains("acceptable_types", F.col("expected_type")),
        "ambiguity without note": ambiguous & unexplained,
        "mixed topic without note": _has("MIXED_TOPIC") & unexplained,
        "angry and urgent without reason":
            _has("ANGRY") & (F.col("expected_priority") == "URGENT") & unexplained,
        "refusal names no bait": _has("REFUSAL") & (F.size("must_not_assert") == 0),
    })


def gold_quota_predicate(column: str, value: str) -> Column:
    """Membership test behind a named quota: array columns contain, others equal."""
    return F.array_contains(column, value) if column == "tags" else F.col(column) == value


def quota_violations(rows: DataFrame,
                     quotas: Sequence[tuple[str, Column | str, int | None, int | None]],
                     bounds: tuple[int, int] | None = None) -> DataFrame:
    """Unmet quotas from one pass of conditional counts.

    A quota is (name, predicate, minimum, exact) with exactly one bound; the
    predicate is a Column or a SQL string, so callers can bring their own.
    """
    for name, _, minimum, exact in quotas:
        if (minimum is None) == (exact is None):
            raise ValueError(f"quota {name!r} needs exactly one of minimum and exact")
    preds = [F.expr(p) if isinstance(p, str) else p for _, p, _, _ in quotas]
    counted = rows.groupBy().agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(p).alias(f"_q{i}") for i, p in enumerate(preds)])
    checks = []
    for i, (name, _, minimum, exact) in enumerate(quotas):
        n = F.col(f"_q{i}")
        broken = n != exact if exact is not None else n < minimum
        want = f"exactly {exact}" if exact is not None else f"at least {minimum}"
        checks.append(F.when(broken, F.struct(
            F.lit(name).alias("key"), F.lit("quota").alias("rule"),
            F.format_string(f"expected {want}, found %d", n).alias("detail"))))
    if bounds is not None:
        n = F.col("_rows")
        checks.append(F.when(~n.between(*bounds), F.struct(
            F.lit("record count").alias("key"), F.lit("quota").alias("rule"),
            F.format_string(f"expected {bounds[0]}-{bounds[1]}, found %d", n).alias("detail"))))
    return counted.select(F.inline(F.filter(F.array(*checks), lambda x: x.isNotNull())))


def duplicate_payloads(rows: DataFrame, payload: str, keys: Sequence[str] = ()) -> DataFrame:
    """Payloads that occur more than once; grouped by digest so texts are not shuffled."""
    return (rows.groupBy(*keys, F.sha2(payload, 256).alias("digest"))
            .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1))


# ---- banded validation sets --------------------------------------------------------------
def variant_violations(variants: DataFrame, suffix: str = "letter") -> DataFrame:
    """Row rules of a banded variant: range, id suffix and id number agree with the record.

    ``suffix`` is "letter" (A for band 0 upwards) or "score" (the target score).
    """
    band = F.col("expected_band")
    last = (F.element_at(F.split("variant_id", "-"), -1))
    want = F.char(F.lit(65) + band) if suffix == "letter" else F.col("target_score").cast("string")
    number = F.element_at(F.split("variant_id", "-"), 2)
    rules = {
        "suffix does not match": ~F.coalesce(last == want, F.lit(False)),
        "id number does not match record":
            ~F.coalesce(number == F.element_at(F.split("record_id", "-"), 2), F.lit(False)),
    }
    if "score_low" in variants.columns:
        low = F.element_at(F.array(*[F.lit(b[0]) for b in fixed.STANDARD_BANDS]), band + 1)
        high = F.element_at(F.array(*[F.lit(b[1]) for b in fixed.STANDARD_BANDS]), band + 1)
        rules["score range does not match band"] = (
            (F.col("score_low") != low) | (F.col("score_high") != high))
    if "target_score" in variants.columns:
        targets = [t for pair in fixed.BOUNDARY_PAIRS for t in pair]
        rules["target score not declared"] = ~F.col("target_score").isin(*targets)
        rules["band does not match target"] = ~F.coalesce(
            band == band_of(F.col("target_score"), F.lit("actionability")), F.lit(False))
    if "pair_id" in variants.columns:
        rules["pair does not match record"] = ~F.coalesce(
            F.element_at(F.split("pair_id", "-"), 2) == F.element_at(F.split("record_id", "-"), 2),
            F.lit(False))
    if "fault_count" in variants.columns:
        n = F.col("fault_count")
        rules["fault count does not fit band"] = (
            F.when(band == 3, n != 0).when(band == 0, n < 2).otherwise(n != 1))
    return violations(variants, "variant_id", rules)


def _set_rules(frame: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    found = F.filter(F.array(*[F.when(p, F.lit(n)) for n, p in rules.items()]),
                     lambda x: x.isNotNull())
    return frame.select(F.concat_ws("/", *keys).alias("key"), F.explode(found).alias("rule"),
                        F.lit(None).cast("string").alias("detail"))


def balanced_set_violations(variants: DataFrame, keys: Sequence[str], variants_wanted: int = 24,
                            records_wanted: int = 6, bands: int = 4) -> DataFrame:
    """Set rules: size, unique ids and replies, equal bands, every record covers all bands."""
    per_record = variants.groupBy(*keys, "record_id").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("expected_band"))).alias("_bands"),
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col("expected_band") == b).alias(f"_b{b}") for b in range(bands)])
    size = per_record.groupBy(*keys).agg(
        F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_records"),
        F.count_if(F.col("_bands") != (1 << bands) - 1).alias("_partial"),
        *[F.sum(f"_b{b}").alias(f"_b{b}") for b in range(bands)])
    uneven = F.lit(False)
    for b in range(bands):
        uneven = uneven | (F.col(f"_b{b}") != records_wanted)
    out = _set_rules(size, keys, {
        "variant count": F.col("_n") != variants_wanted,
        "record count": F.col("_records") != records_wanted,
        "bands uneven": uneven,
        "record misses a band": F.col("_partial") > 0,
    })
    return out.unionByName(repeated(variants, keys, "variant_id", "variant ids not unique")
                           ).unionByName(repeated(variants, keys, "draft_reply",
                                                  "draft replies not unique"))


def repeated(rows: DataFrame, keys: Sequence[str], column: str, rule: str) -> DataFrame:
    """Sets that hold some value of a column twice."""
    twice = duplicate_payloads(rows, column, keys)
    return twice.select(F.concat_ws("/", *keys).alias("key")).distinct().select(
        "key", F.lit(rule).alias("rule"), F.lit(None).cast("string").alias("detail"))


def boundary_set_violations(variants: DataFrame, keys: Sequence[str], variants_wanted: int = 18,
                            pairs_wanted: int = 9, per_boundary: int = 3,
                            boundaries: Sequence[tuple[int, int]] = fixed.BOUNDARY_PAIRS
                            ) -> DataFrame:
    """Boundary-pair rules: each pair is one declared boundary of one record; counts are equal."""
    pair = variants.groupBy(*keys, "pair_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("target_score").alias("_low"),
        F.max("target_score").alias("_high"), F.min("record_id").alias("_ra"),
        F.max("record_id").alias("_rb"),
        *[F.count_if(F.col("target_score") == t).alias(f"_t{t}")
          for b in boundaries for t in b])

    def on(b: tuple[int, int]) -> Column:
        return (F.col("_n") == 2) & (F.col("_low") == b[0]) & (F.col("_high") == b[1])

    declared = F.lit(False)
    for b in boundaries:
        declared = declared | on(b)
    name = F.concat_ws("/", *keys, "pair_id")
    broken = pair.select(name.alias("key"), F.explode(F.filter(F.array(
        F.when(~declared, F.lit("not one complete boundary pair")),
        F.when(F.col("_ra") != F.col("_rb"), F.lit("pair spans records"))),
        lambda x: x.isNotNull())).alias("rule"), F.lit(None).cast("string").alias("detail"))
    size = pair.groupBy(*keys).agg(
        F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_pairs"),
        *[F.sum(f"_t{t}").alias(f"_t{t}") for b in boundaries for t in b],
        *[F.count_if(on(b)).alias(f"_b{i}") for i, b in enumerate(boundaries)])
    targets, bounds = F.lit(False), F.lit(False)
    for i, b in enumerate(boundaries):
        bounds = bounds | (F.col(f"_b{i}") != per_boundary)
        for t in b:
            targets = targets | (F.col(f"_t{t}") != per_boundary)
    return broken.unionByName(_set_rules(size, keys, {
        "variant count": F.col("_n") != variants_wanted,
        "pair count": F.col("_pairs") != pairs_wanted,
        "targets uneven": targets,
        "boundaries uneven": bounds,
    }))


def shared_records(a: DataFrame, b: DataFrame, key: str = "record_id") -> DataFrame:
    """Records in both a development and a holdout set; must be empty."""
    return a.select(key).intersect(b.select(key))


# ---- labels and blind reviews ------------------------------------------------------------
def label_violations(labels: DataFrame, metrics: Sequence[str] = tuple(fixed.RUBRIC),
                     kind: str | None = None) -> DataFrame:
    """Unknown metric, duplicate (record, metric), value not an integer 0-10.

    ``kind`` names a column with the JSON type of the raw value, so booleans and
    text are told apart from integers; without it ``human`` is already typed.
    """
    name = F.concat_ws("|", "record_id", "metric")
    bad = ~F.col("human").between(0, 10)
    if kind is not None:
        bad = (F.col(kind) != "VOID") & ((F.col(kind) != "BIGINT") | F.coalesce(bad, F.lit(True)))
    rules = {"unknown metric": ~F.col("metric").isin(*metrics), "not an integer 0-10": bad}
    out = violations(labels.withColumn("_key", name), "_key", rules)
    twice = labels.groupBy("record_id", "metric").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return out.unionByName(twice.select(name.alias("key"), F.lit("duplicate label").alias("rule"),
                                        F.col("n").cast("string").alias("detail")))


def label_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Labels from JSON lines: record_id, metric, human and ``kind``, the JSON type of the raw score.

    ``kind`` is MISSING without the field and BROKEN where the line is no JSON, so that
    ``label_violations`` rejects both; only an integer gives a score. Other columns stay.
    """
    parsed = lines.withColumn("_v", F.try_parse_json(value))
    raw = F.try_variant_get("_v", "$.human", "variant")
    kind = F.when(F.col("_v").isNull(), "BROKEN").otherwise(
        F.coalesce(F.schema_of_variant(raw), F.lit("MISSING")))
    return (parsed.withColumn("kind", kind)
            .withColumn("record_id", F.try_variant_get("_v", "$.record_id", "string"))
            .withColumn("metric", F.try_variant_get("_v", "$.metric", "string"))
            .withColumn("human", F.when(F.col("kind") == "BIGINT",
                                        F.try_variant_get("_v", "$.human", "bigint"))).drop("_v"))


def label_progress(labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Total, completed and missing counts; agreement stays hidden until missing is 0."""
    return labels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count("human").alias("completed"),
        F.count_if(F.col("human").isNull()).alias("missing"))


def missing_labels(labels: DataFrame) -> DataFrame:
    """Keys still to be labelled, without any rater score."""
    return labels.filter(F.col("human").isNull()).select("record_id", "metric")


def blind_violations(scores: DataFrame, key: DataFrame, metric: str) -> DataFrame:
    """Blind scores must be the expected ids once each, 0-10, banded alike, with a reason."""
    counted = scores.groupBy("blind_id").agg(F.count(F.lit(1)).alias("_n"))
    ids = counted.join(key.select("blind_id").withColumn("_k", F.lit(1)), "blind_id", "full_outer")
    id_rules = violations(ids, "blind_id", {
        "unexpected id": F.col("_k").isNull(), "missing id": F.col("_n").isNull(),
        "duplicate id": F.col("_n") > 1})
    value = F.col("score")
    return id_rules.unionByName(violations(scores, "blind_id", {
        "score not in 0-10": ~F.coalesce(value.between(0, 10), F.lit(False)),
        "band disagrees with score":
            ~F.coalesce(F.col("band") == band_of(value, F.lit(metric)), F.lit(False)),
        "empty reason": _blank("reason"),
    }))


def preference_violations(reviews: DataFrame, expected: DataFrame,
                          allowed: Sequence[str] = fixed.PREFERENCES) -> DataFrame:
    """Preference rows must be exactly the expected records, from the closed set, with reasons."""
    counted = reviews.groupBy("record_id").agg(F.count(F.lit(1)).alias("_n"))
    ids = counted.join(expected.select("record_id").withColumn("_k", F.lit(1)), "record_id",
                       "full_outer")
    out = violations(ids, "record_id", {
        "unexpected id": F.col("_k").isNull(), "missing id": F.col("_n").isNull(),
        "duplicate id": F.col("_n") > 1})
    return out.unionByName(violations(reviews, "record_id", {
        "unknown preference": ~F.col("preferred").isin(*allowed),
        "preference without reason": F.col("preferred").isNotNull() & _blank("reason")}))


def subset_violations(subset: DataFrame, source: DataFrame, labels: DataFrame,
                      columns: Sequence[str], key: str = "id") -> DataFrame:
    """A demo subset copies the source verbatim, keeps the declared order and has labels.

    ``subset`` carries ``ord`` (position found) and ``declared`` (position wanted). Both
    sides are digested where they are read, so whole texts never reach a shuffle.
    """
    content = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    original = source.select(key, content.alias("_source"))
    known = labels.select(key).distinct().withColumn("_labelled", F.lit(True))
    joined = (subset.select(key, "ord", "declared", content.alias("_copy"))
              .join(original, key, "left").join(known, key, "left"))
    return violations(joined, key, {
        "not in source": F.col("_source").isNull(),
        "not verbatim": F.col("_source").isNotNull() & (F.col("_copy") != F.col("_source")),
        "out of order": F.col("ord") != F.col("declared"),
        "no label": F.col("_labelled").isNull()})


# ---- plans and roles -----------------------------------------------------------------------
def plan_violations(plan: DataFrame, slot: str = "slot") -> DataFrame:
    """Slots contiguous from 1 and unique; hard cases and OTHER need distinct briefs."""
    span = plan.groupBy().agg(
        F.min(slot).alias("lo"), F.max(slot).alias("hi"), F.count(F.lit(1)).alias("n"),
        F.count_distinct(slot).alias("d"))
    whole = _set_rules(span.withColumn("_set", F.lit("plan")), ["_set"], {
        "slots not contiguous": (F.col("lo") != 1) | (F.col("hi") - F.col("lo") + 1 != F.col("d")),
        "slots not unique": F.col("d") != F.col("n")})
    hard = _has("REFUSAL") | _has("INJECTION")
    rows = violations(plan, slot, {
        "hard case without brief": hard & _blank("note"),
        "OTHER without brief": (F.col("case_type") == "OTHER") & _blank("note"),
        "refusal typed OTHER": _has("REFUSAL") & (F.col("case_type") == "OTHER"),
        "urgent address change":
            (F.col("case_type") == "ADDRESS_CHANGE") & (F.col("priority") == "URGENT")})
    briefs = plan.filter((F.col("case_type") == "OTHER") & ~_blank("note"))
    same = briefs.groupBy("note").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.col("note").alias("key"), F.lit("brief repeated").alias("rule"),
        F.col("n").cast("string").alias("detail"))
    return whole.unionByName(rows).unionByName(same)


def plan_drift(plan: DataFrame, delivered: DataFrame, key: str) -> DataFrame:
    """Delivered labels that differ from the planned ones (sets compared unordered)."""
    wanted = plan.select(key, F.col("case_type").alias("_t"), F.col("priority").alias("_p"),
                         F.array_sort("tags").alias("_g"),
                         F.col("acceptable_types").alias("_a"))
    joined = delivered.join(wanted, key)
    return violations(joined, key, {
        "type drifted": ~F.col("expected_type").eqNullSafe(F.col("_t")),
        "priority drifted": ~F.col("expected_priority").eqNullSafe(F.col("_p")),
        "tags drifted": ~F.array_sort("tags").eqNullSafe(F.col("_g")),
        "acceptable types drifted": ~F.col("acceptable_types").eqNullSafe(F.col("_a"))})


def family_conflicts(roles: DataFrame, tested: DataFrame) -> DataFrame:
    """Roles that must stay apart from the models under test.

    The generator may not share a family (the text before the first dash) with a
    tested model; the other roles may not be a tested model.
    """
    family = F.split_part(F.col("model"), F.lit("-"), F.lit(1))
    families = tested.select(family.alias("_f")).distinct()
    models = tested.select(F.col("model").alias("_m")).distinct()
    related = roles.filter(F.col("role") == "generator").join(
        families, family == F.col("_f"), "left_semi").select(
        F.col("role").alias("key"), F.lit("shares a family").alias("rule"),
        F.col("model").alias("detail"))
    identical = roles.filter(F.col("role") != "generator").join(
        models, F.col("model") == F.col("_m"), "left_semi").select(
        F.col("role").alias("key"), F.lit("is a model under test").alias("rule"),
        F.col("model").alias("detail"))
    return related.unionByName(identical)
