"""Entity groundedness: are the facts of a draft present in its source text?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.columns import lits, strip
from .redact import winning_spans

WORD = "[a-z]+|[0-9]+"
_DATE_PART = "(?<![a-z])(?:" + "|".join(fixed.MONTHS) + ")|[0-9]+"
_MONTH_WORD = r"(?i)\b(?:" + "|".join(fixed.MONTHS) + ")"
# The two non-ASCII letters whose lower case is or holds an ASCII letter.
_FOLDING = "\u212a\u0130"


def normalise(text: Column) -> Column:
    """Comparable form: lower case, no commas, no trailing .00, single spaces."""
    plain = F.translate(F.lower(text), "\u00a0,", " ")
    whole = F.regexp_replace(plain, r"([0-9])\.00\b", "$1")
    return F.trim(F.regexp_replace(whole, r"\s+", " "))


def _lowered(text: Column) -> Column:
    return F.lower(F.translate(text, _FOLDING, "  "))


def words(text: Column) -> Column:
    """Letter runs and digit runs, so respaced times compare alike."""
    return F.regexp_extract_all(_lowered(text), F.lit(WORD), F.lit(0))


def date_core(text: Column) -> Column:
    """Numbers and month prefixes of a text. A word that starts like a month counts."""
    return F.regexp_extract_all(_lowered(text), F.lit(_DATE_PART), F.lit(0))


def entity_groundedness(pairs: DataFrame, source: str = "source", draft: str = "draft",
                        key: str = "record_id") -> DataFrame:
    """Per draft: entities, unsupported entities and score (1.0 without entities).

    An entity is supported when its normalised text occurs in the source, when
    all its words do (honorifics and salutations aside), or, for a date, when
    its numbers and months do. Vague dates count as entities but are never
    flagged. A missing draft is skipped, not scored.

    The source is read for what is still open only: its normalised text if the draft
    has entities, its words or dates if one of them does not occur in that. What the
    open entities share with it is intersected once per row, so a long source is
    scanned once and not once per entity.
    """
    found = winning_spans(pairs.select(key, source, draft), draft, out="_spans")
    ignored = lits(fixed.HONORIFICS + fixed.SALUTATIONS)
    staged = found.select(
        key, F.col(draft).alias("_draft"), F.col(source).alias("_source"),
        F.when(F.size("_spans") > 0, normalise(F.col(source))).alias("_norm"),
        F.transform("_spans", lambda s: F.struct(
            s["entity"].alias("entity"), strip(s["text"]).alias("text"),
            normalise(s["text"]).alias("norm"))).alias("_e"))

    def is_open(e: Column) -> Column:
        vague = (e["entity"] == "DATE_TIME") & ~(e["text"].rlike("[0-9]") | e["text"].rlike(_MONTH_WORD))
        return (e["norm"] != "") & ~vague & ~F.coalesce(F.contains(F.col("_norm"), e["norm"]), F.lit(False))

    staged = staged.withColumn("_open", F.transform(F.filter("_e", is_open), lambda e: F.struct(
        e["entity"].alias("entity"), e["text"].alias("text"),
        F.array_except(words(e["text"]), ignored).alias("words"),
        F.when(e["entity"] == "DATE_TIME", date_core(e["text"])).alias("core"))))
    known = F.when(F.size("_open") > 0, F.array_intersect(
        F.flatten(F.transform("_open", lambda e: e["words"])), words(F.col("_source"))))
    dates = F.when(F.exists("_open", lambda e: e["entity"] == "DATE_TIME"), F.array_intersect(
        F.flatten(F.filter(F.transform("_open", lambda e: e["core"]), lambda c: c.isNotNull())),
        date_core(F.col("_source"))))

    def unsupported(e: Column, held: Column) -> Column:
        dated = (e["entity"] == "DATE_TIME") & (F.size(F.array_except(e["core"], held["dates"])) == 0)
        worded = F.size(F.array_except(e["words"], held["known"])) == 0
        return ~(F.coalesce(dated, F.lit(False)) | F.coalesce(worded, F.lit(False)))

    # An array of one binds what the source holds to a name; as columns the optimizer
    # would move it into the filter and read the source once per entity.
    findings = F.transform(F.array(F.struct(known.alias("known"), dates.alias("dates"))), lambda held: F.transform(
        F.filter("_open", lambda e: unsupported(e, held)), lambda e: F.concat_ws(":", e["entity"], e["text"])))
    staged = staged.withColumn("findings", F.get(findings, F.lit(0)))
    total, bad = F.size("_e"), F.size("findings")
    score = F.when(total == 0, 1.0).otherwise(1 - bad / total)
    made = F.col("_draft").isNotNull()
    return staged.select(
        key, F.when(made, total).alias("entities"), F.when(made, bad).alias("ungrounded"),
        F.when(made, score).alias("score"), F.when(made, F.col("findings")).alias("findings"),
        F.when(made, "scored").otherwise("skipped").alias("status"))
