"""Collecting queries by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import name_local_folder

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Builder
    sql: str | None


QUERIES: dict[str, Query] = {}


def prepared(build: Builder) -> Builder:
    """The query with a work folder named first where a local session has none."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        name_local_folder(spark)
        return build(spark, folder)

    return run


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def register(build: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Query(prepared(build), sql)
        return build

    return register


def oracles() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql}
