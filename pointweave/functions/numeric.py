"""Numbers: finiteness, rounding to digits, medians of arrays, units, grid cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")
#: Unit name to units in a metre.
UNITS = {"m": 1.0, "cm": 100.0, "mm": 1000.0}


def finite(*columns: Column) -> Column:
    """True where all values are numbers other than NaN and the infinities; false for null."""
    return F.coalesce(reduce(lambda a, b: a & b, [F.abs(c.cast("double")) < F.lit(INFINITY) for c in columns]), F.lit(False))


def significant(value: Column, digits: int) -> Column:
    """A number rounded to so many significant digits, for equality of printed values."""
    power = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.round(value * power) / power)


def array_median(values: Column) -> Column:
    """The median of an array's non-null values; null if there is none."""
    s = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(s)
    return F.when(n == 0, None).otherwise((F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def half_even(value: Column) -> Column:
    """A number rounded to a whole one, halves to even."""
    return F.bround(value, 0)


def cell(value: Column, size: float) -> Column:
    """The index of the grid cell of a coordinate."""
    return F.floor(value / F.lit(float(size))).cast("long")


def convert_length(value: Column, unit: str) -> Column:
    return value * F.lit(UNITS[unit])


def convert_area(value: Column, unit: str) -> Column:
    return value * F.lit(UNITS[unit] ** 2)
