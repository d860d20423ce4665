"""Audit records: sinks, JSON forms, queries and usage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DataType, DoubleType, LongType, MapType, StringType,
                               StructField, StructType)

from clientlens.functions.keys import summarize_result

# Fields of an audit record in order, the default status, and the actions logged.
AUDIT_FIELDS = ("timestamp", "action", "user_id", "customer_id", "details", "ip_address", "session_id", "status")
DEFAULT_STATUS = "success"
TOOL_CALL = "tool_call"
CUSTOMER_ACCESS = "customer_data_access"

# JSON schema types; any other name is text.
JSON_TYPES: dict[str, DataType] = {
    "string": StringType(),
    "integer": LongType(),
    "number": DoubleType(),
    "boolean": BooleanType(),
    "array": ArrayType(StringType()),
    "object": MapType(StringType(), StringType()),
}


def iso_timestamp(ts: Column) -> Column:
    """ISO 8601 text, with microseconds only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def audit_entries(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The audit record's fields, after those to ``keep``; absent ones are null, an absent status is success."""
    present = set(df.columns)
    columns = [F.col(f) if f in present else F.lit(None).cast("string").alias(f) for f in AUDIT_FIELDS[:-1]]
    status = F.col("status") if "status" in present else F.lit(None).cast("string")
    return df.select(*keep, *columns, F.coalesce(status, F.lit(DEFAULT_STATUS)).alias("status"))


def _as_json(text: Column) -> Column:
    """A text's JSON value, or the text as a JSON string where it is none."""
    listed = F.to_json(F.array(text))
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.substring(listed, F.lit(2), F.length(listed) - 2)))


def _entries(df: DataFrame, action: str, details: Column, keep: Sequence[str]) -> DataFrame:
    known = [c for c in AUDIT_FIELDS if c in df.columns and c not in ("action", "details")]
    text = F.to_json(details, {"ignoreNullFields": "false"})
    return audit_entries(df.select(*keep, *known, F.lit(action).alias("action"), text.alias("details")), keep)


def tool_call_entries(calls: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Audit records of tool calls.

    ``calls`` has tool, arguments (JSON text), result and execution_time_ms
    beside the record's own fields; the result is logged by its first 500
    characters.
    """
    return _entries(calls, TOOL_CALL, F.struct(
        F.col("tool"), _as_json(F.coalesce("arguments", F.lit("{}"))).alias("arguments"),
        summarize_result(F.col("result")).alias("result_summary"), F.col("execution_time_ms")), keep)


def customer_access_entries(accesses: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Audit records of access to customer data: ``access_type`` and ``data_fields`` (none if null)."""
    fields = F.coalesce("data_fields", F.array().cast("array<string>"))
    return _entries(accesses, CUSTOMER_ACCESS, F.struct(F.col("access_type"), fields.alias("data_fields")), keep)


def write_audit(df: DataFrame, path: str) -> None:
    """Append records under one folder per day.

    The rebalance groups a day's rows into files of advisory size and splits a
    day that is too large for one.
    """
    entries = audit_entries(df).withColumn("date", F.to_date("timestamp"))
    entries.hint("rebalance", "date").write.mode("append").partitionBy("date").parquet(path)


def read_audit(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def to_audit_json(df: DataFrame, name: str = "audit_json") -> DataFrame:
    """The record as JSON with nulls kept.

    ``details`` is embedded as JSON where it parses, as a string where it does
    not, and is {} when absent.
    """
    entries = audit_entries(df)
    details = _as_json(F.coalesce("details", F.lit("{}")))
    fields = {f: F.col(f) for f in AUDIT_FIELDS} | {"timestamp": iso_timestamp(F.col("timestamp")), "details": details}
    record = F.struct(*[c.alias(f) for f, c in fields.items()])
    return entries.select("*", F.to_json(record, {"ignoreNullFields": "false"}).alias(name))


def structured_json(df: DataFrame, timestamp: str, message: str, context: Mapping[str, object] | None = None,
                    extra_cols: Sequence[str] = (), name: str = "log_json") -> DataFrame:
    """A JSON line of timestamp, message, context and extras; later keys overwrite earlier ones."""
    fields: dict[str, Column] = {"timestamp": iso_timestamp(F.col(timestamp)), "message": F.col(message)}
    fields.update({k: F.lit(v) for k, v in (context or {}).items()})
    fields.update({c: F.col(c) for c in extra_cols})
    line = F.struct(*[value.alias(key) for key, value in fields.items()])
    return df.withColumn(name, F.to_json(line, {"ignoreNullFields": "false"}))


def query_audit(df: DataFrame, start=None, end=None, action: str | None = None, user_id: str | None = None) -> DataFrame:
    """Records within inclusive time bounds and of one action and user, each optional."""
    if start:
        df = df.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end:
        df = df.where(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    if "date" in df.columns:
        # Stored records: the same bounds on the partition column skip whole days.
        if start:
            df = df.where(F.col("date") >= F.lit(start).cast("timestamp").cast("date"))
        if end:
            df = df.where(F.col("date") <= F.lit(end).cast("timestamp").cast("date"))
    if action:
        df = df.where(F.col("action") == action)
    if user_id:
        df = df.where(F.col("user_id") == user_id)
    return df


def audit_usage(audit: DataFrame) -> DataFrame:
    """Calls, customers reached and mean execution time per action and user."""
    return audit.groupBy("action", "user_id").agg(
        F.count("*").alias("calls"), F.count_distinct("customer_id").alias("customers_accessed"),
        F.avg("execution_time_ms").alias("avg_execution_time_ms"))


def args_struct(json_schema: Mapping) -> StructType:
    """Typed fields of a JSON schema's properties."""
    properties = json_schema.get("properties", {})
    return StructType([StructField(n, JSON_TYPES.get(p.get("type", "string"), StringType()), True)
                       for n, p in properties.items()])


def validate_json_args(df: DataFrame, json_col: str, json_schema: Mapping) -> DataFrame:
    """Typed arguments, required fields that are missing, and whether the call is valid.

    A field present with a value of another type is listed in ``mistyped``.
    """
    fields = args_struct(json_schema)
    required = [n for n in json_schema.get("required", []) if n in fields.names]
    text = F.col(json_col)
    parsed = df.withColumn("_raw", F.try_parse_json(text)).withColumn("_values", F.from_json(text, "map<string,string>"))
    if fields.names:
        parsed = parsed.withColumn("args", F.from_json(text, fields))
    else:
        parsed = parsed.withColumn("args", F.lit(None).cast("struct<>"))

    def absent(n: str) -> Column:
        return F.col("_values").getItem(n).isNull()

    missing = F.array(*[F.when(absent(n), n) for n in required]).cast("array<string>")
    mistyped = F.array(*[F.when(~absent(n) & F.col("args").getField(n).isNull(), n) for n in fields.names]).cast("array<string>")
    return (parsed.withColumn("missing", F.array_compact(missing))
            .withColumn("mistyped", F.array_compact(mistyped))
            .withColumn("valid", F.col("_raw").isNotNull() & (F.size("missing") == 0) & (F.size("mistyped") == 0))
            .drop("_raw", "_values"))
