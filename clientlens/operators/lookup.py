"""Table lookup and aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, column: str, value, return_columns: Sequence[str]) -> DataFrame:
    """Rows whose ``column`` equals a value, or any value of a one-column DataFrame.

    A scalar reaches the scan as a pushed filter; a DataFrame becomes a semi join
    whose strategy AQE picks from the measured sizes.
    """
    if isinstance(value, DataFrame):
        wanted = value.select(F.col(value.columns[0]).alias("_wanted")).distinct()
        df = df.join(wanted, df[column] == wanted["_wanted"], "left_semi")
    elif isinstance(value, (list, tuple, set)):
        df = df.where(F.col(column).isin(list(value)))
    else:
        df = df.where(F.col(column) == F.lit(value))
    return df.select(*return_columns)


def aggregate_table(df: DataFrame, group_by: str, aggregations: Mapping[str, str],
                    filter_value=None) -> DataFrame:
    """Named SQL aggregations per group, for one group only when asked."""
    if filter_value:
        df = df.where(F.col(group_by) == F.lit(filter_value))
    return df.groupBy(group_by).agg(*[F.expr(e).alias(a) for a, e in aggregations.items()])
