"""Where the query modules put their queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.oracle_views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(spark, directory)`` with its SQL counterpart."""
    def add(build):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build
    return add


def joined(values: str | Column, separator: str = "|") -> Column:
    """A list as text, so that results are flat."""
    return F.array_join(values, separator)


def day(value: str | Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


def stamp(value: str | Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")


def flat(df: DataFrame, lists: Sequence[str] = (), days: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """Lists as text and dates as ISO text."""
    columns = []
    for c in df.columns:
        if c in drop:
            continue
        value = joined(c) if c in lists else day(c) if c in days else F.col(c)
        columns.append(value.alias(c))
    return df.select(*columns)
