"""Registered queries: a Spark function of (session, folder) and, where SQL can say the same, its ANSI text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFunction = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    run: QueryFunction
    sql: str | None


QUERIES: dict[str, Registered] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
    def add(function: QueryFunction) -> QueryFunction:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Registered(function, sql)
        return function

    return add
