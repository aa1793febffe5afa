"""Column expressions with the number semantics that the queries share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_int(text: Column) -> Column:
    """Whole number of a trimmed text; null where it is none ("4.5", "5+")."""
    return F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).try_cast("int"))


def to_float(text: Column) -> Column:
    """Decimal number of a trimmed text, a comma counting as a point; null where it is none."""
    plain = F.trim(F.regexp_replace(text, ",", "."))
    return F.when(plain.rlike(_FLOAT), plain.try_cast("double"))


def to_time(text: Column) -> Column:
    """Time without zone from ``yyyy-MM-dd HH:mm:ss`` or ``yyyy-MM-dd``; null otherwise."""
    trimmed = F.trim(text)
    return F.coalesce(
        F.try_to_timestamp(trimmed, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(trimmed, F.lit("yyyy-MM-dd"))
    ).cast("timestamp_ntz")


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate; null (no error) where either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def min_max(value: Column, low: Column, high: Column, inverse: bool = False) -> Column:
    """Position of a value between two bounds, from 0 to 1; 0.5 where the bounds meet, inverse or not."""
    place = F.try_divide(value - low, high - low)
    return F.when(low == high, F.lit(0.5)).otherwise(F.lit(1.0) - place if inverse else place)
