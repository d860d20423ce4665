"""Windowed transaction monitoring with late rows dropped at the watermark."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.operators.compliance import HIGH_VALUE, SUSPICIOUS, alert_columns


_UNITS = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6,
          "day": 86_400 * 10**6, "week": 7 * 86_400 * 10**6}


def _micros(span: str) -> int:
    """Microseconds of a span such as "1 day 12 hours"."""
    parts = span.lower().removeprefix("interval ").split()
    if not parts or len(parts) % 2:
        raise ValueError(f"not a span: {span!r}")
    return sum(int(n) * _UNITS[unit.rstrip("s")] for n, unit in zip(parts[::2], parts[1::2], strict=True))


def stream_alerts(stream: DataFrame, window: str = "1 day", watermark: str = "1 hour", slide: str | None = None,
                  high: float = HIGH_VALUE, suspicious: float = SUSPICIOUS, key: str = "customer_id",
                  ts: str = "ts", amount: str = "amount") -> DataFrame:
    """Counts, sums and alerts per customer and event-time window (sliding with ``slide``).

    Events are first aggregated in panes, the longest spans that windows are made
    of, and windows are sums of panes: an event is one row whatever the number of
    windows it falls in. Works on a stream or a table; on a stream, append mode
    emits a window once the watermark has passed its end. State is one row per
    key and open pane or window, since the aggregates combine before the shuffle.
    """
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark)
    kind, _ = alert_columns(F.col(amount), high, suspicious)
    pane = window if slide is None else f"{gcd(_micros(window), _micros(slide))} microseconds"
    counted = timed.withColumn("_kind", kind).groupBy(F.window("_ts", pane).alias("window"), F.col(key)).agg(
        F.count("*").alias("transactions"), F.sum(amount).alias("total_amount"),
        F.count_if(F.col("_kind") == "HIGH_VALUE").alias("high_value_alerts"),
        F.count_if(F.col("_kind") == "SUSPICIOUS").alias("suspicious_alerts"))
    if slide is not None:
        sums = ["transactions", "total_amount", "high_value_alerts", "suspicious_alerts"]
        counted = counted.groupBy(F.window(F.window_time("window"), window, slide).alias("window"), F.col(key)).agg(
            *[F.sum(c).alias(c) for c in sums])
    return counted.select(key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                          "transactions", "total_amount", "high_value_alerts", "suspicious_alerts")
