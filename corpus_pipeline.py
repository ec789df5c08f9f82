"""Corpus pipeline over ``documents``: quality, line dedup, near duplicates, mixing, encoding.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that the stage
before it kept. ``run`` writes every stage's rows as Parquet into the shared folder
and reads them back, so a lost executor costs one stage at most. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewright.llm import jaccard, line_dedup, mixing, pieces, quality_rules
from gradewright.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rule_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality rules reject; the model is fitted to labelled rows of the input."""
    model = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.apply_rules(docs.select(COLUMNS), model).filter("kept").select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that an earlier document holds; n_chars follows the text."""
    return (line_dedup.drop_repeated_lines(docs.select(COLUMNS))
            .withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of every near-duplicate group, once; rows without id stay."""
    docs = docs.select(COLUMNS)
    keep = (jaccard.similar_components(docs).filter("doc_id = component_id")
            .select("doc_id").distinct())
    kept = (docs.join(keep, "doc_id", "left_semi").withColumn("_text", F.xxhash64("text"))
            .dropDuplicates(["doc_id", "_text"]))
    return kept.select(COLUMNS).unionByName(docs.filter("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicate to tempered source weights and shuffle globally."""
    return mixing.mix(docs.select(COLUMNS)).select(COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add token_ids and n_tokens, and whether decoding gives the text back."""
    codec = pieces.Codec(pieces.Vocabulary.read())
    rows = pieces.encode(docs.select(COLUMNS), codec, check="round_trip")
    return rows.select(*COLUMNS, "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("quality rules", rule_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_near_duplicates),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

#: A trained model and a segmentation search have no SQL form; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
