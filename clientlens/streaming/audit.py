"""Masked audit records from a live stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clientlens.functions.text import mask_json
from clientlens.operators.audit import audit_entries


def masked_entries(records: DataFrame) -> DataFrame:
    """Audit records with personal data masked in ``details``, by key and value where it is JSON."""
    return audit_entries(records).withColumn("details", mask_json(F.col("details")))


def stream_audit(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append masked records to parquet, one folder per day, exactly once per file."""
    entries = masked_entries(stream).withColumn("date", F.to_date("timestamp"))
    writer = (entries.writeStream.format("parquet").outputMode("append").partitionBy("date")
              .option("path", path).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
