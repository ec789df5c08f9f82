"""The registered queries of the corpus operators and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from . import (exact_dedup, html_text, jaccard, licences, line_dedup, minhash, mixing, periodic,
               pieces, quality_net, quality_rules, toxicity, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def register(oracle: str | None = None):
    def keep(build):
        QUERIES[build.__name__] = build
        if oracle is not None:
            ORACLES[build.__name__] = oracle
        return build
    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register(f"""
WITH d AS (SELECT doc_id, sha256({LOWER_SQL}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY ALL)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
""")
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, shared_dir(spark, "digest-index"))
    decided = index.add(table(spark, folder, "documents"), "documents")
    return decided.select("doc_id", "keep_id", "group_size", "kept",
                          F.lower(F.hex("digest")).alias("text_sha256"))


@register(f"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (
  SELECT k, min(doc_id) AS low FROM keyed WHERE length(k) >= {line_dedup.MIN_CHARS}
  GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT doc_id, pos, line, low IS NOT NULL AND low <> doc_id AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@register()
def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    codec = pieces.Codec(pieces.Vocabulary.read())
    encoded = pieces.encode(table(spark, folder, "documents").select("doc_id", "text"), codec)
    return pieces.digests(encoded, codec)


@register()
def op3_quality_net(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    net = quality_net.train(docs, table(spark, folder, "labels"))
    return quality_net.score(docs, net).select("doc_id", "held_out", "score", "predicted")


def linked_sql(least: int, kept: str = "") -> str:
    """Components of documents whose shingle sets have a Jaccard similarity of ``least`` per cent."""
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({LOWER_SQL}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= {jaccard.WORDS}
    THEN list_distinct(list_transform(range(1, len(w) - {jaccard.WORDS - 2}),
      lambda i: array_to_string(w[i:i + {jaccard.WORDS - 1}], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
held AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c
  FROM held a JOIN held b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared WHERE 100 * c >= {least} * (nx + ny - c)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, s.y FROM reach r JOIN sides s ON r.other = s.x),
lowest AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s) AS n_shingles, component_id{kept} FROM sets JOIN lowest USING (doc_id)
"""


@register(linked_sql(jaccard.NUM))
def op4_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_components(table(spark, folder, "documents"))


@register()
def op5_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).drop("html")


@register()
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality_rules.train(docs, table(spark, folder, "labels"))
    return quality_rules.apply_rules(docs, model).drop("text")


@register(licences.oracle())
def op8_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


@register(mixing.ORACLE.format(docs="documents"))
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@register()
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


@register()
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.digests(periodic.find_runs(periodic.looped(table(spark, folder, "documents"))))


@register(linked_sql(minhash.NUM, ", doc_id = component_id AS kept"))
def op12_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


@register()
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
