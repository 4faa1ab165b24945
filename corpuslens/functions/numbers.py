"""Rounding as Python does it: on the exact binary value, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = float((1 << 27) + 1)
_WHOLE = float(1 << 53)  # from here on doubles have no fraction


def _units(magnitude: Column, digits: int) -> Column:
    """A value from 0 in whole units of the last kept digit.

    The shortest decimal that names a double decides unless it is a tie; then the exact value of the
    double is compared with the tie: value * 2 * 10**digits - odd number, with the value in two halves
    of 26 bits, so that every product and difference is exact.
    """
    power = 10**digits
    decimal = magnitude.cast("decimal(38,18)")
    whole = F.floor(decimal * power).cast("bigint")
    rest = decimal * power - whole
    high = magnitude * _SPLIT - (magnitude * _SPLIT - magnitude)
    beyond = (high * float(2 * power) - (2 * whole + 1).cast("double")) + (magnitude - high) * float(2 * power)
    up = (rest > 0.5) | ((rest == 0.5) & ((beyond > 0) | ((beyond == 0) & (whole % 2 == 1))))
    return whole + F.when(up, 1).otherwise(0)


def _has_fraction(value: Column, digits: int) -> Column:
    return F.abs(value) * float(10**digits) < _WHOLE


def _negative(value: Column) -> Column:
    """Below zero, or the zero with a minus sign."""
    return F.startswith(value.cast("string"), F.lit("-"))


def exact_round(value: Column, digits: int) -> Column:
    """``round(value, digits)``; null, infinite, NaN and huge values stay as they are."""
    value = value.cast("double")
    rounded = _units(F.abs(value), digits) / float(10**digits)
    return F.when(_has_fraction(value, digits), F.when(_negative(value), -rounded).otherwise(rounded)).otherwise(value)


def one_decimal(value: Column) -> Column:
    """Text with one decimal, as reports and prompts show it."""
    value = value.cast("double")
    units = _units(F.abs(value), 1)
    small = F.concat(F.floor(units / 10).cast("string"), F.lit("."), (units % 10).cast("string"))
    large = F.concat(F.abs(value).cast("decimal(38,0)").cast("string"), F.lit(".0"))
    sign = F.when(_negative(value), "-").otherwise("")
    return F.concat(sign, F.when(_has_fraction(value, 1), small).otherwise(large))
