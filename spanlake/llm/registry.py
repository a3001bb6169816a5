"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanlake.session import ship_package, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, reads: str, sql: str | None = None):
    """Register `fn(*tables) -> DataFrame` over the whole of the given tables that `reads` names."""

    def wrap(fn: Callable[..., DataFrame]):
        def run(spark: SparkSession, root: str) -> DataFrame:
            return fn(*[table(ship_package(spark), root, name) for name in reads.split()])

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
