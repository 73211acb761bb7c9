"""Exact units: a factor into the base of a dimension. Calendar units never become seconds."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unit, dimension, factor to the dimension's base.
UNITS = (
    ("second", "time", "1"), ("minute", "time", "60"), ("hour", "time", "3600"), ("day", "time", "86400"), ("week", "time", "604800"),
    ("month", "calendar", "1"), ("year", "calendar", "12"),
    ("meter", "distance", "1"), ("kilometer", "distance", "1000"), ("mile", "distance", "1609.344"), ("foot", "distance", "0.3048"),
    ("gram", "mass", "1"), ("kilogram", "mass", "1000"), ("pound", "mass", "453.59237"),
    ("USD", "currency:USD", "1"), ("EUR", "currency:EUR", "1"), ("GBP", "currency:GBP", "1"),
)
#: Small numbers in words.
WORD_NUMBERS = dict(zip("zero one two three four five six seven eight nine ten eleven twelve".split(), range(13), strict=True))


def unit_table(spark: SparkSession) -> DataFrame:
    """(unit, dimension, factor): a dimension table of fixed size, safe to broadcast."""
    return spark.createDataFrame([(u, d, Decimal(f)) for u, d, f in UNITS], "unit string, dimension string, factor decimal(18,8)")


def singular(unit: Column) -> Column:
    """A unit's name without its plural ending."""
    low = F.lower(unit)
    return F.when(low == "feet", "foot").when(low.endswith("s") & (F.char_length(low) > 2), F.substring(low, F.lit(1), F.char_length(low) - 1)).otherwise(low)


def number(text: Column) -> Column:
    """Digits with separators, or a small number in words, as a decimal; else null."""
    words = F.create_map(*[x for w, n in WORD_NUMBERS.items() for x in (F.lit(w), F.lit(n))])
    return F.coalesce(F.regexp_replace(text, ",", "").try_cast("decimal(28,6)"), F.try_element_at(words, F.lower(text)).cast("decimal(28,6)"))
