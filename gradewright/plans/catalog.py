"""All registered queries. Importing a module registers what it defines."""

from . import checks, intake, quality, release, streams, texts  # noqa: F401
from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
