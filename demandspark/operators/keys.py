"""One row per key, chosen by order. Written as partial aggregations, never as a window over the key:
a key that holds a third of the rows is reduced before it is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    by = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), by).alias("_row"))
    return chosen.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The whole row with the smallest order value; give enough order columns to break ties."""
    return _pick(df, keys, order, F.min_by)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The whole row with the largest order value."""
    return _pick(df, keys, order, F.max_by)


def restrict(df: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``allowed`` (left semi join)."""
    return df.join(allowed.select(key).distinct(), key, "left_semi")
