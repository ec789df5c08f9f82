"""Doubles as integers of the same order, so that value ranges can be split exactly by shifts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MANTISSA = 52
_ONE = float(1 << MANTISSA)
_INFINITE = 2047 << MANTISSA


def ordered_bits(value: Column) -> Column:
    """A bigint per double in the same order, one for each value; NaN is above all.

    For a positive double it is its IEEE 754 bit pattern, for a negative one that of its
    absolute value with a minus. Powers of two are exact, and dividing by one loses no bit.
    """
    whole = F.abs(value.cast("double"))
    size = F.when((whole > 0) & (whole < float("inf")), whole).otherwise(1.0)
    guess = F.floor(F.log2(size))
    low = F.pow(F.lit(2.0), guess)
    # The logarithm may round across a power of two: take the exponent that holds the value.
    exponent = F.greatest(guess + F.when(low > size, -1).when(low * 2 <= size, 1).otherwise(0),
                          F.lit(-1022))
    tail = ((size / F.pow(F.lit(2.0), exponent) - 1) * F.lit(_ONE)).cast("bigint")
    bits = (F.when(whole == 0, F.lit(0)).when(F.isnan(whole), F.lit(_INFINITE + 1))
            .when(whole == float("inf"), F.lit(_INFINITE))
            .otherwise((exponent + 1023).cast("bigint") * F.lit(1 << MANTISSA) + tail))
    return F.when(value < 0, -bits).otherwise(bits)


def from_ordered_bits(bits: Column) -> Column:
    """The double of ``ordered_bits``; both zeros come back as 0."""
    size = F.abs(bits)
    field = F.shiftright(size, MANTISSA)
    tail = size.bitwiseAND((1 << MANTISSA) - 1).cast("double") / F.lit(_ONE)
    value = (F.when(size > _INFINITE, F.lit(float("nan"))).when(size == _INFINITE, F.lit(float("inf")))
             .when(field == 0, tail * F.lit(2.0 ** -1022))
             .otherwise((tail + 1) * F.pow(F.lit(2.0), field - 1023)))
    return F.when(bits < 0, -value).otherwise(value)
