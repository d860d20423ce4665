"""Small fixed dimension tables. Each has a handful of rows by definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Units of each currency per US dollar.
FX_RATES = {
    "USD": 1.0,
    "EUR": 0.92,
    "GBP": 0.79,
    "SGD": 1.34,
    "AUD": 1.53,
    "JPY": 149.5,
}

# Reporting thresholds per jurisdiction, in reporting order.
REPORTING_THRESHOLDS = {
    "SG": (("CTR", 20000.0), ("STR", 0.0)),
    "US": (("CTR", 10000.0), ("SAR", 5000.0)),
    "UK": (("SAR", 0.0),),
    "EU": (("CTR", 10000.0),),
}
DEFAULT_THRESHOLDS = (("CTR", 10000.0),)

# Document type by the first phrase found, in this order.
DOCUMENT_RULES = (
    ("investment_product", ("unit trust", "fund")),
    ("kyc_document", ("kyc", "verification")),
    ("transaction_record", ("transaction",)),
    ("risk_assessment", ("risk",)),
)

# Which team answers a question mentioning these words.
ROUTING_RULES = (
    ("customer_specialist", ("customer", "profile", "balance")),
    ("product_specialist", ("product", "recommend", "unit trust", "fund")),
    ("compliance_officer", ("kyc", "aml", "sanction", "compliance")),
    ("analytics_expert", ("calculate", "analyze", "convert", "metric")),
    ("document_analyst", ("document", "factsheet", "summar")),
)


def _literal(value) -> str:
    if isinstance(value, bool) or value is None:
        raise TypeError(value)
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def _values(spark: SparkSession, rows, columns) -> DataFrame:
    """A local relation: its exact size is known to the optimizer."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def fx_rates(spark: SparkSession) -> DataFrame:
    """currency, rate."""
    return _values(spark, FX_RATES.items(), ["currency", "rate"])


def thresholds(spark: SparkSession) -> DataFrame:
    """jurisdiction, report_type, threshold, ord."""
    rows = [(j, kind, limit, i) for j, pairs in REPORTING_THRESHOLDS.items()
            for i, (kind, limit) in enumerate(pairs)]
    return _values(spark, rows, ["jurisdiction", "report_type", "threshold", "ord"])


def doc_rules(spark: SparkSession) -> DataFrame:
    """ord, document_type, phrase."""
    rows = [(i, kind, phrase) for i, (kind, phrases) in enumerate(DOCUMENT_RULES) for phrase in phrases]
    return _values(spark, rows, ["ord", "document_type", "phrase"])


def routing_rules(spark: SparkSession) -> DataFrame:
    """ord, specialist, phrase."""
    rows = [(i, who, phrase) for i, (who, phrases) in enumerate(ROUTING_RULES) for phrase in phrases]
    return _values(spark, rows, ["ord", "specialist", "phrase"])
