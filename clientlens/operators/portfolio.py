"""Portfolio allocation, risk and rebalancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientlens.common import round_half_up
from clientlens.functions.scores import ladder

VOLATILITY_BANDS = ((0.5, "Low"), (1.5, "Medium"))
TOP_VOLATILITY_BAND = "High"


def portfolio_allocation(holdings: DataFrame) -> DataFrame:
    """Share of each asset class per customer, in percent.

    The window runs over classes, not holdings.
    """
    per_class = holdings.groupBy("customer_id", "asset_class").agg(F.sum("value").alias("class_value"))
    total = F.sum("class_value").over(Window.partitionBy("customer_id"))
    return per_class.select(
        "customer_id", "asset_class",
        round_half_up(F.col("class_value"), 2).alias("class_value"),
        round_half_up(total, 2).alias("total_value"),
        (F.try_divide(F.col("class_value"), total) * 100).alias("allocation"))


def period_returns(transactions: DataFrame) -> DataFrame:
    """Change of a customer's quarterly volume over the quarter before."""
    quarterly = transactions.groupBy("customer_id", F.trunc("ts", "quarter").alias("period")).agg(
        F.sum("amount").alias("volume"))
    previous = F.lag("volume").over(Window.partitionBy("customer_id").orderBy("period"))
    return (quarterly.withColumn("return", F.try_divide(F.col("volume"), previous) - 1)
            .where(F.col("return").isNotNull()).select("customer_id", "period", "return"))


def portfolio_risk(holdings: DataFrame, returns: DataFrame) -> DataFrame:
    """Value-weighted risk, volatility, Sharpe ratio and diversification per customer."""
    per_class = holdings.groupBy("customer_id", "asset_class").agg(
        F.sum("value").alias("v"), F.sum(F.col("value") * F.col("risk_rating")).alias("weighted"))
    sums = per_class.groupBy("customer_id").agg(
        F.sum("v").alias("v"), F.sum("weighted").alias("weighted"), F.sum(F.col("v") * F.col("v")).alias("squares"))
    spread = returns.groupBy("customer_id").agg(
        F.avg("return").alias("mean"), F.stddev_samp("return").alias("deviation"))
    return sums.join(spread, "customer_id", "left").select(
        "customer_id",
        round_half_up(F.col("v"), 2).alias("total_value"),
        round_half_up(F.try_divide(F.col("weighted"), F.col("v")), 4).alias("portfolio_risk_score"),
        ladder(F.col("deviation"), VOLATILITY_BANDS, TOP_VOLATILITY_BAND).alias("volatility"),
        round_half_up(F.try_divide(F.col("mean"), F.col("deviation")), 4).alias("sharpe_ratio"),
        round_half_up(100 * (1 - F.try_divide(F.col("squares"), F.col("v") * F.col("v"))), 4)
        .alias("diversification_score"))


def rebalance_advice(allocation: DataFrame, targets: DataFrame, band: float = 5.0) -> DataFrame:
    """Classes further than ``band`` points from their target weight.

    A customer's missing classes count as 0 percent.
    """
    held = allocation.select("customer_id", "asset_class", "allocation")
    wanted = targets.select("asset_class", "target")
    # Gaps: every customer has one row per target class it does not hold, found
    # from the map of what it holds. The number of classes is small and fixed.
    per_customer = held.groupBy("customer_id").agg(
        F.map_from_entries(F.collect_list(F.struct("asset_class", "allocation"))).alias("_held"))
    plan = wanted.agg(F.collect_list(F.struct("asset_class", "target")).alias("plan")).scalar()
    full = (per_customer.withColumn("_t", F.explode(plan))
            .select("customer_id", F.col("_t.asset_class").alias("asset_class"), F.col("_t.target").alias("target"),
                    F.coalesce(F.col("_held")[F.col("_t.asset_class")], F.lit(0.0)).alias("allocation")))
    drift = F.col("allocation") - F.col("target")
    points = F.round(F.abs(drift).cast("decimal(38,6)"), 1).cast("string")
    return (full.where(F.abs(drift) > band)
            .withColumn("drift", round_half_up(drift, 4))
            .withColumn("recommendation", F.when(
                drift > 0, F.concat(F.lit("Consider reducing "), "asset_class", F.lit(" exposure by "), points, F.lit("%")))
                .otherwise(F.concat(F.lit("Consider adding "), "asset_class", F.lit(" exposure of "), points, F.lit("%"))))
            .select("customer_id", "asset_class", "target", "drift", "recommendation"))
