"""Fixed decimals: a whole number of 10^-exponent units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_double(x: Column, exponent: int = 6) -> Column:
    """Units, rounded to the nearest (halves away from zero)."""
    return F.round(x * float(10**exponent)).cast("long")


def to_double(units: Column, exponent: int = 6) -> Column:
    return units / float(10**exponent)


def convert(units: Column, exponent: int, to: int) -> Column:
    """To another exponent; digits that it lacks are cut off."""
    if to >= exponent:
        return units * 10 ** (to - exponent)
    return F.when(units < 0, -F.floor(-units / float(10 ** (exponent - to)))).otherwise(F.floor(units / float(10 ** (exponent - to)))).cast("long")


def display(units: Column, exponent: int = 6) -> Column:
    """With all its digits after the point, without a minus before zero."""
    whole = F.floor(F.abs(units) / 10**exponent).cast("long").cast("string")
    rest = F.lpad((F.abs(units) % 10**exponent).cast("string"), exponent, "0")
    return F.concat(F.when(units < 0, "-").otherwise(""), whole, F.lit("."), rest)
