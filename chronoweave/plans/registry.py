"""Registered queries: a Spark job over the given tables, with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from chronoweave.plans.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register the function under its own name; `covers` lists the inventory rows it answers."""

    def add(build: Callable[[Tables], DataFrame]):
        if build.__name__ in REGISTRY:
            raise ValueError(f"query registered twice: {build.__name__}")
        REGISTRY[build.__name__] = Query(build.__name__, tuple(covers.split()), build, sql)
        return build

    return add
