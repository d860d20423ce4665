"""Hashes, cache keys and JSON access."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_hash(text: Column) -> Column:
    """MD5 of the UTF-8 text, as hex."""
    return F.md5(text)


def request_key(df: DataFrame, cols: Sequence[str], name: str = "request_key") -> DataFrame:
    """MD5 of the arguments as JSON with sorted keys; nulls count as values."""
    arguments = F.struct(*[F.col(c) for c in sorted(cols)])
    return df.withColumn(name, F.md5(F.to_json(arguments, {"ignoreNullFields": "false"})))


def summarize_result(text: Column, length: int = 500) -> Column:
    """First characters of a result, as logged."""
    return F.left(text, F.lit(length))


def json_field(df: DataFrame, column: str, path: str, name: str, as_type: str = "string") -> DataFrame:
    """Field of a JSON text column; null where absent or of another type."""
    return df.withColumn(name, F.get_json_object(column, path).try_cast(as_type))
