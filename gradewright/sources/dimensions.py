"""Dimension loads with their checks: prices, evidence sources, claims, services."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed, schemas
from ..functions.columns import lits, strip, violations
from .jsonl import duplicate_keys


def price_rows(documents: DataFrame, value: str = "value") -> DataFrame:
    """Price map documents to one row per model; a half-filled entry keeps its NULL."""
    prices = F.from_json(F.get_json_object(F.col(value), "$.prices"), schemas.PRICES)
    return documents.select(F.explode(prices).alias("model", "p")).select(
        "model", "p.input_per_mtok", "p.output_per_mtok")


def _duplicates(rows: DataFrame, key: str) -> DataFrame:
    return duplicate_keys(rows, key).select(
        F.col(key).cast("string").alias("key"), F.lit("duplicate id").alias("rule"),
        F.col("n").cast("string").alias("detail"))


def source_violations(sources: DataFrame, as_of: str,
                      hosts: Sequence[str] = fixed.TRUSTED_HOSTS) -> DataFrame:
    """Untrusted host, future review date, duplicate id. ``as_of`` fixes "today"."""
    host = F.try_parse_url(F.col("url"), F.lit("HOST"))
    rules = {
        "untrusted host": ~F.coalesce(host.isin(*hosts), F.lit(False)),
        "future review date": F.col("verified_on").cast("date") > F.to_date(F.lit(as_of)),
    }
    return violations(sources, "id", rules).unionByName(_duplicates(sources, "id"))


def _blank(name: str) -> Column:
    return F.coalesce(F.length(strip(name)), F.lit(0)) == 0


def claim_violations(claims: DataFrame) -> DataFrame:
    """Duplicate id, blank claim text or locator."""
    return violations(claims, "id", {
        "blank claim": _blank("claim"), "blank locator": _blank("locator"),
    }).unionByName(_duplicates(claims, "id"))


def service_violations(entries: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Duplicate id, blank owner or guidance, topics outside the dictionary."""
    return violations(entries, "id", {
        "blank owner": _blank("owner"), "blank guidance": _blank("guidance"),
        "unknown topic": F.size(F.array_except("topics", lits(topics))) > 0,
    }).unionByName(_duplicates(entries, "id"))


def manifest_violations(manifest: DataFrame, as_of: str,
                        authority: str = "synthetic_internal_contract") -> DataFrame:
    """A catalogue manifest must name its authority, version and scope and be in force."""
    return violations(manifest, "catalogue_id", {
        "wrong authority": ~F.coalesce(F.col("authority_type") == authority, F.lit(False)),
        "future effective date":
            F.col("effective_from").cast("date") > F.to_date(F.lit(as_of)),
        "incomplete manifest": _blank("version") | _blank("scope"),
    })
