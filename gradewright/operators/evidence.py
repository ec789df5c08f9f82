"""Topic tagging and evidence selection."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.columns import col, compact
from .joins import constant, split_join

LOOKUP_PAIRS = 20_000  # pairs of an item and a topic up to which a catalogue is held in the plan


def topics_of(text: Column, terms: Mapping[str, Sequence[str]],
              negated: tuple[str, Sequence[str]] | None = fixed.NEGATED_TOPIC) -> Column:
    """Topics any of whose terms occurs in the text (lower-cased), in dictionary order.

    A negation phrase removes its topic. The dictionary is configuration, so
    each topic compiles to plain substring tests and no join is needed.
    """
    tests = []
    for topic, words in terms.items():
        hit = None
        for word in words:
            one = F.contains(text, F.lit(word))
            hit = one if hit is None else hit | one
        if negated is not None and topic == negated[0]:
            for phrase in negated[1]:
                hit = hit & ~F.contains(text, F.lit(phrase))
        tests.append(F.when(hit, F.lit(topic)))
    return compact(tests)


def tag_topics(texts: DataFrame, text: str | Column, terms: Mapping[str, Sequence[str]],
               negated: tuple[str, Sequence[str]] | None = fixed.NEGATED_TOPIC,
               out: str = "topics") -> DataFrame:
    """Add the topic array; the text is lower-cased once."""
    lowered = texts.withColumn("_low", F.lower(col(text)))
    return lowered.withColumn(out, topics_of(F.col("_low"), terms, negated)).drop("_low")


def topic_lookup(catalogue: DataFrame, most: int = LOOKUP_PAIRS) -> tuple[list[str], dict[str, list[int]]] | None:
    """Item ids in (pack, ord, id) order and, per topic, the places of its items; None if too large.

    A catalogue is configuration. It is brought to the driver only if it has no more than
    ``most`` pairs of an item and a topic, which is counted first.
    """
    pairs = catalogue.select("pack", "ord", "id", F.explode("topics").alias("topic")).distinct()
    if pairs.count() > most:
        return None
    rows = pairs.collect()
    items = sorted({(r["pack"], r["ord"], r["id"]) for r in rows})
    place = {item: i for i, item in enumerate(items)}
    postings: dict[str, list[int]] = {}
    for r in rows:
        postings.setdefault(r["topic"], []).append(place[r["pack"], r["ord"], r["id"]])
    return [item[2] for item in items], {topic: sorted(at) for topic, at in postings.items()}


def select_evidence(tagged: DataFrame, catalogue: DataFrame, key: str, most: int = LOOKUP_PAIRS) -> DataFrame:
    """Add evidence ids: items sharing a topic with the record, in (pack, ord) order.

    A catalogue of up to ``most`` (item, topic) pairs becomes an index from topic to places of items,
    held in the plan: a projection, without any exchange. A larger one is joined on the
    topic, hot topics split over tasks; that gives ``key`` and ``evidence_ids`` only.
    Records without evidence keep an empty array.
    """
    lookup = topic_lookup(catalogue, most)
    if lookup is None:
        items = catalogue.select(F.explode("topics").alias("topic"), F.struct("pack", "ord", "id").alias("item")).distinct()
        hits = split_join(tagged.select(key, F.explode_outer("topics").alias("topic")), items, "topic", "left", unique=False)
        found = hits.groupBy(key).agg(F.array_sort(F.collect_set("item")).alias("_items"))
        return found.select(key, F.transform("_items", lambda s: s["id"]).alias("evidence_ids"))
    ids, postings = lookup
    by_topic = constant(json.dumps(postings), "map<string, array<int>>")
    names = constant(json.dumps(ids), "array<string>")
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(
        F.coalesce(F.col("topics"), F.array().cast("array<string>")),
        lambda t: F.coalesce(F.try_element_at(by_topic, t), F.array().cast("array<int>"))))))
    return tagged.withColumn("evidence_ids", F.transform(places, lambda i: F.get(names, i)))


def context_lines(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Rendered claim lines with provenance; ``line`` is NULL when the source is missing."""
    named = sources.select(F.col("id").alias("source_id"), "publisher", "title", "url",
                           "verified_on", "scope")
    joined = claims.join(named, "source_id", "left")
    line = F.format_string(
        "[%s] %s Source: %s, %s, %s. %s (verified %s; scope: %s)", "id", "claim", "publisher",
        "title", "locator", "url", "verified_on", "scope")
    return joined.select("id", "source_id", F.when(
        F.col("publisher").isNotNull(), line).alias("line"))


def missing_sources(lines: DataFrame) -> DataFrame:
    """Claims whose source does not exist, as violations."""
    return lines.filter(F.col("line").isNull()).select(
        F.col("id").alias("key"), F.lit("missing source").alias("rule"),
        F.col("source_id").alias("detail"))


def evidence_index(claims: DataFrame, sources: DataFrame, services: DataFrame) -> DataFrame:
    """Public claims and service entries under one id space with a ``kind`` column.

    A service entry replaces a claim of the same id.
    """
    public = claims.join(
        sources.select(F.col("id").alias("source_id"), "title", "publisher"), "source_id").select(
        "id", F.lit("public").alias("kind"), "title", "publisher", F.col("claim").alias("guidance"))
    internal = services.select(
        "id", F.lit("synthetic").alias("kind"), F.col("owner").alias("title"),
        F.lit(None).cast("string").alias("publisher"), "guidance")
    return public.join(internal.select("id"), "id", "left_anti").unionByName(internal)


def attach_evidence(cases: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Evidence rows of each case in the order of its id array; unknown ids are dropped.

    An id that a large share of all cases asks for is no hot key: its evidence is broadcast.
    """
    wanted = cases.select(key, F.posexplode("evidence_ids").alias("pos", "id"))
    rows = split_join(wanted, index, "id").groupBy(key).agg(F.array_sort(F.collect_list(
        F.struct("pos", "id", "kind", "title", "guidance"))).alias("evidence"))
    return cases.join(rows, key, "left").withColumn(
        "evidence", F.coalesce("evidence", F.array()))


def stale_rows(rows: DataFrame, key: str, stored: str = "stored_ids", fresh: str = "evidence_ids") -> DataFrame:
    """``stale_evidence`` where stored and recomputed ids are columns of one row: no join."""
    return rows.filter(~F.col(stored).eqNullSafe(F.col(fresh))).select(
        F.col(key).cast("string").alias("key"), F.lit("stale evidence").alias("rule"),
        F.array_join(fresh, ",").alias("detail"))


def stale_evidence(stored: DataFrame, recomputed: DataFrame, key: str) -> DataFrame:
    """Records whose stored evidence ids differ from the recomputed ones, order included."""
    fresh = recomputed.select(key, F.col("evidence_ids").alias("_fresh"))
    joined = stored.join(fresh, key, "left")
    return joined.filter(~F.col("evidence_ids").eqNullSafe(F.col("_fresh"))).select(
        F.col(key).cast("string").alias("key"),
        F.when(F.col("_fresh").isNull(), "unknown record").otherwise("stale evidence").alias("rule"),
        F.array_join("_fresh", ",").alias("detail"))


def unknown_references(rows: DataFrame, used: str, known: DataFrame, id_column: str = "id"
                       ) -> DataFrame:
    """Distinct ids in an array column that the known table does not have."""
    asked = rows.select(F.explode(used).alias(id_column)).distinct()
    return asked.join(known.select(id_column), id_column, "left_anti")
