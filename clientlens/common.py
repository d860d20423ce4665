"""Building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows a lookup side may have before an explicit broadcast hint is dropped and
# the choice is left to AQE's measured sizes.
BROADCAST_ROWS = 100_000


def round_half_up(value: Column, digits: int) -> Column:
    """Decimal rounding, so that ties do not depend on the last binary digits.

    Values beyond the decimal's range are rounded as doubles.
    """
    return F.coalesce(F.round(value.try_cast("decimal(38,7)"), digits).cast("double"), F.round(value.cast("double"), digits))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.transform(F.array(value), lambda bound: body(bound))[0]


def top_n_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
              rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key.

    For ``n`` up to spark.sql.optimizer.windowGroupLimitThreshold (1,000) Spark
    plans a group limit before the shuffle, so a hot key sends at most ``n``
    rows from each task. Beyond it all rows of a key are sorted in one task,
    with the same result.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a side whose row bound is known before it runs."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
