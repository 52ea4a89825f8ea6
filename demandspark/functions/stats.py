"""Aggregate expressions for forecast errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandspark.functions.coerce import safe_ratio

METRICS = ("mae", "rmse", "smape", "mape_nonzero", "nonzero_share", "r2", "mean_actual")
LOWER_IS_BETTER = ("mae", "rmse", "smape", "mape_nonzero")


def regression_aggregates(actual: str, predicted: str) -> list[Column]:
    """All error metrics as one set of partially aggregated expressions, plus ``n``."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    error = p - a
    mse = F.avg(error * error)
    spread = F.var_pop(a)
    return [
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(mse).alias("rmse"),
        (F.avg(safe_ratio(F.abs(error) * 2.0, F.abs(a) + F.abs(p))) * 100.0).alias("smape"),
        (F.avg(F.when(a > 0, F.abs(error / a))) * 100.0).alias("mape_nonzero"),
        F.avg((a > 0).cast("double")).alias("nonzero_share"),
        F.when(spread > 0, 1.0 - F.try_divide(mse, spread)).alias("r2"),
        F.avg(a).alias("mean_actual"),
        F.count(F.lit(1)).alias("n"),
    ]
