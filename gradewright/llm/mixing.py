"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of all characters over its present share. Each
document draws a count from the Poisson distribution of that mean by inverting it at
a hash of seed and id, is exploded by the count, and all copies are dealt out and
ordered by a second hash. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_by_key

SEED = "mix-1"
PART_RATE = 16     # a larger rate is the sum of equal parts of at most this
TERMS = 80         # P(X > 79) at PART_RATE is below 2**-52
BROADCAST_SOURCES = 50_000  # source table broadcast up to this many rows (some 35 MB)


def uniform(*parts: Column) -> Column:
    """Uniform number in [0, 1) on a grid of 2**-52 from an MD5 of the parts."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def cumulative(rate: Column) -> Column:
    """P(X <= k) for k = 0 .. TERMS - 1 of a Poisson variable, as an array."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda acc: acc["cdf"])


def rates(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(_source, rate, parts, cdf) of every source in the documents.

    ``weights``: (source, weight), one row per source, any positive scale; a source that
    is not listed has weight 0. Without it a source weighs the square root of its
    characters, which lifts small sources. Sources without any character keep rate 1.
    """
    sizes = docs.groupBy(F.col("source").alias("_source")).agg(
        F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("chars"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.sqrt("chars"))
    else:
        given = weights.select(F.col("source").alias("_given"), F.col("weight").cast("double").alias("weight"))
        weighed = (sizes.join(given, F.col("_source").eqNullSafe(F.col("_given")), "left")
                   .select("_source", "chars", F.coalesce("weight", F.lit(0.0)).alias("weight")))
    total = weighed.agg(F.sum("chars").alias("all_chars"),
                        F.sum(F.when(F.col("chars") > 0, F.col("weight")).otherwise(0.0)).alias("all_weight"))
    rate = (F.when(F.col("chars") == 0, 1.0)
            .otherwise(F.col("all_chars") * F.col("weight") / F.col("all_weight") / F.col("chars")))
    return (weighed.join(F.broadcast(total)).withColumn("rate", rate)  # one row
            .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE).cast("int")))
            .select("_source", "rate", "parts", cumulative(F.col("rate") / F.col("parts")).alias("cdf")))


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: str = SEED) -> DataFrame:
    """Replicate documents to the target weights and shuffle all copies globally.

    Adds copy (1 .. count) and shuffle_key; the result is dealt to partitions by the key
    and sorted by it within each, so that (partition, key) is a random order that is the
    same for the same seed. A document may have no copy: its count is a Poisson draw.

    Nulls: a null source is a source of its own; a null text has no characters; a null
    doc_id draws like any other id. Rows with one doc_id draw the same count. Other
    columns pass through; ``copy`` and ``shuffle_key`` are replaced. An empty table gives
    an empty result. A source that holds a third of all rows is never moved by source:
    the table of sources is broadcast up to BROADCAST_SOURCES rows, and beyond that the
    hot sources alone are.
    """
    docs = docs.drop("copy", "shuffle_key")
    table = rates(docs, weights)
    columns = docs.columns
    keyed = docs.withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    table = table.select(F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("null")).alias("_source"),
                         F.col("parts").alias("_parts"), F.col("cdf").alias("_cdf"))
    n = docs.select("source").distinct().limit(BROADCAST_SOURCES + 1).count()
    if n <= BROADCAST_SOURCES:
        joined = keyed.join(F.broadcast(table), "_source")
    else:
        joined = join_by_key(keyed, table, "_source")
    doc_id = F.col("doc_id")
    draw = F.aggregate(
        F.sequence(F.lit(1), F.col("_parts")), F.lit(0),
        lambda acc, part: acc + F.size(F.filter("_cdf", lambda c: c <= uniform(F.lit(seed), doc_id, part))))
    one = F.size(F.filter("_cdf", lambda c: c <= F.col("_u")))
    counted = (joined.withColumn("_u", uniform(F.lit(seed), doc_id, F.lit(1)))
               .withColumn("_count", F.when(F.col("_parts") == 1, one).otherwise(draw)))
    copies = (counted.filter("_count > 0")
              .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_count")))))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(doc_id.cast("string"), F.lit("null")),
                            F.col("copy").cast("string")))
    dealt = copies.withColumn("shuffle_key", F.conv(F.substring(key, 1, 15), 16, 10).cast("long"))
    return (dealt.select(*columns, "copy", "shuffle_key").repartition("shuffle_key")
            .sortWithinPartitions("shuffle_key", "doc_id"))


ORACLE = f"""
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS chars FROM {{docs}} GROUP BY source),
weighed AS (
  SELECT source, chars, sqrt(chars) AS weight, sum(chars) OVER () AS all_chars,
    sum(CASE WHEN chars > 0 THEN sqrt(chars) ELSE 0 END) OVER () AS all_weight FROM sizes),
rated AS (
  SELECT source, CASE WHEN chars = 0 THEN 1.0 ELSE all_chars * weight / all_weight / chars END AS rate
  FROM weighed),
parted AS (SELECT source, greatest(1, CAST(ceil(rate / {PART_RATE}) AS INT)) AS parts,
  rate / greatest(1, CAST(ceil(rate / {PART_RATE}) AS INT)) AS r FROM rated),
terms AS (
  SELECT source, parts, r, 0 AS k, exp(-r) AS p, exp(-r) AS cdf FROM parted
  UNION ALL
  SELECT source, parts, r, k + 1, p * r / (k + 1), cdf + p * r / (k + 1) FROM terms WHERE k < {TERMS - 1}),
curves AS (SELECT source, parts, list(cdf ORDER BY k) AS cdf FROM terms GROUP BY source, parts),
draws AS (
  SELECT d.*, c.cdf, unnest(range(1, c.parts + 1)) AS part
  FROM {{docs}} d JOIN curves c ON d.source IS NOT DISTINCT FROM c.source),
counted AS (
  SELECT doc_id, text, lang, source, n_chars, sum(len(list_filter(cdf, lambda x: x <=
    CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || part), 1, 13) AS BIGINT)
    / 4503599627370496.0))) AS n
  FROM draws GROUP BY ALL),
copies AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, CAST(n AS BIGINT) + 1)) AS copy FROM counted)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INT) AS copy,
  CAST('0x' || substr(md5('{SEED}:order:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy), 1, 15) AS BIGINT)
    AS shuffle_key
FROM copies
"""
