"""Tolerant casts and small scalar functions (all Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE_WORDS = ("true", "yes", "y")


def to_int(text: Column, default: int | None = None) -> Column:
    """Text to int: ``7``, ``"7"`` and ``3.0`` pass, anything else becomes the default."""
    text = F.trim(text)
    whole = text.try_cast("int")
    decimal = F.when(text.rlike(r"^[+-]?[0-9]+[.][0-9]*$"), text.try_cast("double").try_cast("int"))
    value = F.coalesce(whole, decimal)
    return value if default is None else F.coalesce(value, F.lit(default))


def to_double(text: Column) -> Column:
    """Text to double; unparseable and not-a-number become NULL."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value), value)


def to_flag(text: Column) -> Column:
    """Booleans, numbers and yes/no words to 0/1; anything else is 0."""
    number = to_int(text)
    word = F.lower(F.trim(text))
    return (
        F.when(number.isNotNull(), F.when(number != 0, 1).otherwise(0))
        .when(word.isin(*TRUE_WORDS), 1)
        .otherwise(0)
        .cast("smallint")
    )


def to_celsius(value: Column, unit: Column) -> Column:
    fahrenheit = F.coalesce(F.upper(unit).endswith("F"), F.lit(False))
    return F.when(fahrenheit, (value - 32.0) * 5.0 / 9.0).otherwise(value)


def wind_kmh(text: Column) -> Column:
    """Mean of the numbers standing alone in the text, converted when it speaks of mph."""
    numbers = F.regexp_extract_all(text, F.lit(r"(?<!\S)([0-9]+[.]?[0-9]*|[.][0-9]+)(?!\S)"), 1)
    values = F.transform(numbers, lambda x: x.cast("double"))
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    mean = F.try_divide(total, F.size(values))
    return F.when(F.lower(text).contains("mph"), mean * 1.609344).otherwise(mean)


def clip0(value: Column, cap: float | None = None) -> Column:
    """Clamp to [0, cap]; NULL stays NULL (``greatest`` alone would turn it into 0)."""
    bounded = F.greatest(value, F.lit(0.0))
    if cap is not None:
        bounded = F.least(bounded, F.lit(float(cap)))
    return F.when(value.isNotNull(), bounded)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio that is 0 where the denominator is 0."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(F.try_divide(numerator, denominator))


def cluster_id(label: Column) -> Column:
    return F.format_string("cluster_%03d", label)
