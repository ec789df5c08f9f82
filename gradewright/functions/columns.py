"""Small Column helpers shared by the operators. All stay JVM-side."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Characters that count as white space at the ends of a text.
WHITE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
         "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(c: Column | str) -> Column:
    """Text without white space at either end; a plain trim only removes blanks."""
    return F.trim(col(c), F.lit(WHITE))


def lstrip(c: Column | str) -> Column:
    """Text without leading white space."""
    return F.ltrim(col(c), F.lit(WHITE))


def lits(values: Iterable) -> Column:
    """Array literal of plain Python values."""
    return F.array(*[F.lit(v) for v in values])


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, NULL when den is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def compact(columns: Sequence[Column]) -> Column:
    """Array of the given columns without the NULL ones."""
    return F.filter(F.array(*columns), lambda x: x.isNotNull())


def inline_items(df: DataFrame, array: str, *keep: str) -> DataFrame:
    """Struct items of an array column as rows, without evaluating the array twice.

    A plain ``inline`` makes the optimizer add a size filter, which is pushed
    into the projection and repeats whatever built the array.
    """
    first = df.schema[array].dataType.elementType.fields[0].name
    return df.select(*keep, F.inline_outer(array)).filter(F.col(first).isNotNull())


def violations(df: DataFrame, key: Column | str, rules: Mapping[str, Column],
               detail: Column | None = None) -> DataFrame:
    """One row per (key, rule) broken. Each rule is a predicate that is true when broken.

    A predicate that evaluates to NULL counts as not broken, so rules about
    absent values have to say ``isNull`` themselves.
    """
    shown = detail if detail is not None else F.lit(None).cast("string")
    broken = compact([F.when(pred, F.lit(name)) for name, pred in rules.items()])
    return df.select(
        col(key).cast("string").alias("key"),
        F.explode(broken).alias("rule"),
        shown.alias("detail"),
    )


def fail_on(found: DataFrame, what: str) -> None:
    """Raise when a violations frame is not empty; looks at a few rows only."""
    rows = found.take(5)
    if rows:
        raise ValueError(f"{what}: " + "; ".join(f"{r['key']}: {r['rule']}" for r in rows))


def fill_grid(counts: DataFrame, keys: Sequence[str], grid: Mapping[str, Sequence],
              value: str) -> DataFrame:
    """Add zero rows so that every key has every cell of a small literal grid.

    The grid is exploded from literals next to one map per key, so there is no
    cross join; the map is bounded by the grid size.
    """
    dims = list(grid)
    cell = F.concat_ws("\x1f", *[F.col(d).cast("string") for d in dims])
    out = counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(cell, F.col(value)))).alias("_cells"))
    for d, values in grid.items():
        out = out.withColumn(d, F.explode(lits(values)))
    return out.select(
        *keys, *dims,
        F.coalesce(F.try_element_at("_cells", cell), F.lit(0)).alias(value))


def seeded(value: Column, salt: Column, modulus: int) -> Column:
    """Stable number below ``modulus`` from the first 8 hex digits of a salted hash."""
    digest = F.sha2(F.concat(salt, F.lit(":"), value), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.lit(modulus)
