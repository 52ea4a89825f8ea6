"""Hourly demand analytics on Spark: ingest, panel features, forecasting and monitoring as DataFrame operators."""

from demandspark.params import Params

__all__ = ["Params"]
