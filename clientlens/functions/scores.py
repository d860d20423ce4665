"""Risk scores and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens.common import round_half_up

# Upper bounds (exclusive) of the customer risk levels.
RISK_LEVELS = ((30, "LOW"), (50, "MEDIUM"), (70, "HIGH"))
TOP_RISK_LEVEL = "CRITICAL"

# Upper bounds (exclusive) of the residual risk levels.
RESIDUAL_LEVELS = ((1, "Low"), (2.5, "Medium"), (4, "High"))
TOP_RESIDUAL_LEVEL = "Critical"
RISK_APPETITE = 2.5


def ladder(value: Column, steps, top: str) -> Column:
    """Name of the first step whose bound exceeds ``value``; null stays null."""
    chain = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, name in steps:
        chain = chain.when(value < bound, name)
    return chain.otherwise(top)


def risk_level(score: Column) -> Column:
    return ladder(score, RISK_LEVELS, TOP_RISK_LEVEL)


def residual_risk(df: DataFrame, inherent: str = "inherent_risk_score",
                  effectiveness: str = "control_effectiveness") -> DataFrame:
    """Risk left after controls; the reduction is null where inherent risk is 0."""
    raw = F.col("_residual")
    return df.withColumn("_residual", F.col(inherent) * (1 - F.col(effectiveness) / 100)).select(
        *[F.col(c) for c in df.columns],
        round_half_up(raw, 2).alias("residual_risk_score"),
        ladder(raw, RESIDUAL_LEVELS, TOP_RESIDUAL_LEVEL).alias("residual_risk_level"),
        round_half_up((1 - F.try_divide(raw, F.col(inherent))) * 100, 1).alias("risk_reduction"),
        (raw < RISK_APPETITE).alias("within_appetite"),
        F.when(raw >= RISK_APPETITE, "Additional controls recommended")
        .when(raw < RISK_APPETITE, "Risk within appetite").alias("recommendation"),
    )
