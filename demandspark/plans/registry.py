"""Named queries over the driver tables, each with the operators it covers and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: QueryFn
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None, name: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        key = name or fn.__name__
        if key in REGISTRY:
            raise ValueError(f"query {key!r} registered twice")
        REGISTRY[key] = Query(key, tuple(covers.split()), fn, sql)
        return fn

    return register


def load_all() -> dict[str, Query]:
    from demandspark.plans import demand, features, modelling, monitoring, proxying, storage  # noqa: F401

    return REGISTRY
