"""Profile → suitable products → compliance, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.operators.products import DEFAULT_RESULTS, suitable_products


def recommend(customers: DataFrame, products: DataFrame, compliance: DataFrame | None = None,
              n: int = DEFAULT_RESULTS) -> DataFrame:
    """Ranked suitable products per customer with the customer's compliance status.

    ``compliance`` is the one-row-per-customer result of ``compliance_check``; it
    meets the customers before they are multiplied by the products.
    """
    profile = customers.withColumn("customer_risk", F.col("risk_rating"))
    keep = ["name", "customer_risk"]
    if compliance is not None:
        profile = profile.join(compliance.select("customer_id", "overall_status"), "customer_id", "left")
        keep.append("overall_status")
    return suitable_products(profile, products, n, keep)
