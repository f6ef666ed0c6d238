"""Every operator as a query on the test tables, with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from querydelta.sources.tables import Tables


@dataclass(frozen=True)
class Registered:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


REGISTRY: dict[str, Registered] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated ``tables -> DataFrame`` function under ``name``."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Registered(name, build, sql)
        return build

    return add


def load() -> dict[str, Registered]:
    from querydelta.registry import (  # noqa: F401
        aggregates, audit, compare, datagen, evidence, joins, membership, ordering, predicates, reports, sets, structure, windows,
    )

    return REGISTRY
