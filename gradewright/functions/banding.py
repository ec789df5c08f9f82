"""Rubric bands, rounding and interval arithmetic as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed


def band_of(score: Column, metric: Column,
            rubric: Mapping[str, tuple] = fixed.RUBRIC) -> Column:
    """Rubric band of a 0-10 score. NULL for an unknown metric or a score off the scale."""
    out = None
    for bands in dict.fromkeys(rubric.values()):
        names = [m for m, b in rubric.items() if b == bands]
        ladder = None
        for index, (low, high) in enumerate(bands):
            hit = score.between(low, high)
            ladder = F.when(hit, index) if ladder is None else ladder.when(hit, index)
        here = metric.isin(*names)
        out = F.when(here, ladder) if out is None else out.when(here, ladder)
    return out


def rater_band(score: Column, metric: Column,
               rubric: Mapping[str, tuple] = fixed.RUBRIC) -> Column:
    """Band of a 0-1 score, rounded half-even to 0-10 first (``rint`` rounds half-even)."""
    return band_of(F.rint(score * 10), metric, rubric)


def wilson(hits: Column, n: Column, z: float = fixed.WILSON_Z) -> tuple[Column, Column]:
    """Wilson interval of hits/n, clamped to [0, 1]; NULL when n is 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = hits / n
    spread = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / spread
    half = F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * z / spread
    known = n.isNotNull()
    return (F.when(known, F.greatest(F.lit(0.0), middle - half)),
            F.when(known, F.least(F.lit(1.0), middle + half)))


def required_n(p: Column, half_width: float = fixed.HALF_WIDTH,
               z: float = fixed.WILSON_Z) -> Column:
    """Sample size for a given half-width at accuracy p."""
    inside = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ceil(F.lit(z * z) * inside * (1 - inside) / F.lit(half_width * half_width))


def shown_confidence(value: Column) -> Column:
    """Three digits, truncated and never rounded up."""
    return F.floor(value * 1000) / 1000
