"""Functions in the session: typed Python functions and SQL functions."""

from __future__ import annotations

import types
import typing
from collections.abc import Callable
from functools import wraps

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DataType, DoubleType, LongType, MapType, StringType)

from clientlens.sources.dimensions import FX_RATES

DEFAULT_CATALOG = "spark_catalog"
DEFAULT_SCHEMA = "default"

# SQL types of Python types; any other is text.
PYTHON_TYPES: dict[type, DataType] = {
    str: StringType(),
    int: LongType(),
    float: DoubleType(),
    bool: BooleanType(),
    list: ArrayType(StringType()),
    dict: MapType(StringType(), StringType()),
}


def sql_type(hint) -> DataType:
    """SQL type of a Python annotation; Optional[x] is (nullable) x."""
    if typing.get_origin(hint) in (typing.Union, types.UnionType):
        members = [a for a in typing.get_args(hint) if a is not type(None)]
        if len(members) == 1:
            return sql_type(members[0])
    return PYTHON_TYPES.get(hint, StringType())


def catalog_function(catalog: str = DEFAULT_CATALOG, schema: str = DEFAULT_SCHEMA, comment: str = "") -> Callable:
    """Attach catalog metadata to a typed Python function."""
    def attach(f: Callable) -> Callable:
        @wraps(f)
        def call(*args, **kwargs):
            return f(*args, **kwargs)

        call.catalog_metadata = {
            "catalog": catalog, "schema": schema, "function_name": f.__name__,
            "comment": comment or f.__doc__ or "", "full_name": f"{catalog}.{schema}.{f.__name__}",
        }
        return call
    return attach


def register_function(spark: SparkSession, f: Callable, name: str | None = None):
    """Register for SQL under its own name, typed by its annotations, in Arrow batches."""
    returns = sql_type(typing.get_type_hints(f).get("return", str))
    return spark.udf.register(name or f.__name__, F.udf(f, returnType=returns, useArrow=True))


def create_convert_to_usd(spark: SparkSession, name: str = "convert_to_usd") -> None:
    """convert_to_usd(amount, currency): a SQL function the optimizer inlines."""
    pairs = ", ".join(f"'{c}', {r!r}D" for c, r in FX_RATES.items())
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(amount DOUBLE, currency STRING) RETURNS DOUBLE
        RETURN CAST(round(CAST(amount / coalesce(map({pairs})[upper(currency)], 1.0D) AS DECIMAL(38, 7)), 2) AS DOUBLE)
    """)


def create_lookup_customer_info(spark: SparkSession, name: str = "lookup_customer_info",
                                view: str = "customers") -> None:
    """lookup_customer_info(customer_name) over a customer view."""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(customer_name STRING)
        RETURNS TABLE(customer_id BIGINT, name STRING, risk_rating INT, account_balance DOUBLE)
        RETURN SELECT customer_id, name, risk_rating, account_balance FROM {view}
               WHERE {view}.name = {name}.customer_name
    """)


def create_lookup_ut_info(spark: SparkSession, name: str = "lookup_ut_info", view: str = "unit_trust") -> None:
    """lookup_ut_info(risk): the unit trusts of one risk rating."""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(risk INT)
        RETURNS TABLE(product_id BIGINT, product_name STRING, risk_rating INT, currency STRING, expense_ratio DOUBLE)
        RETURN SELECT product_id, product_name, risk_rating, currency, expense_ratio FROM {view}
               WHERE {view}.risk_rating = {name}.risk
    """)


def create_vector_search(spark: SparkSession, name: str = "unit_trust_vector_search", view: str = "embeddings") -> None:
    """unit_trust_vector_search(query_vec, k): nearest rows of a (vec_id, embedding) view.

    Stays in the JVM; the rank filter becomes a top-k of each task.
    """
    def total(body: str) -> str:
        return f"aggregate({body}, 0.0D, (s, x) -> s + x)"

    dot = total("zip_with(embedding, query_vec, (x, y) -> coalesce(CAST(x AS DOUBLE) * y, 0.0D))")
    norm = total("transform(embedding, x -> CAST(x AS DOUBLE) * CAST(x AS DOUBLE))")
    query_norm = total("transform(query_vec, x -> x * x)")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(query_vec ARRAY<DOUBLE>, k INT)
        RETURNS TABLE(vec_id BIGINT, score DOUBLE, rank INT)
        RETURN SELECT vec_id, score, rank FROM (
            SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (
                SELECT vec_id, round(coalesce(try_divide({dot}, sqrt({norm}) * sqrt({query_norm})), 0.0D), 6) AS score
                FROM {view}))
        WHERE rank <= {name}.k
    """)


def register_functions(spark: SparkSession) -> None:
    """All SQL functions over the registered domain views."""
    create_convert_to_usd(spark)
    create_lookup_customer_info(spark)
    create_lookup_ut_info(spark)
    create_vector_search(spark)
