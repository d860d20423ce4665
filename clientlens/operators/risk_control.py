"""Risk-and-control self assessment: coverage, effectiveness, summaries, indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientlens.common import round_half_up
from clientlens.functions.scores import ladder

# The period assumed when none is given.
DEFAULT_PERIOD = "Q4 2024"
DEFAULT_SUMMARY_PERIOD = "2024"

EFFECTIVENESS_BANDS = ((65, "Ineffective"), (75, "Partially Effective"))
TOP_EFFECTIVENESS = "Effective"
UNTESTED = "Not Tested"


def control_effectiveness(tests: DataFrame, controls: DataFrame, period: str | None = None) -> DataFrame:
    """Exceptions, design and operating scores of each control for one period.

    A control without tests in the period has no samples, null scores and the
    rating ``Not Tested``.
    """
    period = period or DEFAULT_PERIOD
    results = tests.where(F.col("period") == period).groupBy("control_id").agg(
        F.count("*").alias("samples_tested"), F.count_if("exception").alias("exceptions_found"))
    rate = F.try_divide(F.col("exceptions_found"), F.col("samples_tested"))
    operating = (1 - rate) * 100
    score = (F.col("design_score") + operating) / 2
    return controls.join(results, "control_id", "left").select(
        "control_id",
        F.lit(period).alias("assessment_period"),
        F.coalesce("samples_tested", F.lit(0)).alias("samples_tested"),
        F.coalesce("exceptions_found", F.lit(0)).alias("exceptions_found"),
        round_half_up(rate, 4).alias("exception_rate"),
        F.col("design_score").alias("design_effectiveness"),
        round_half_up(operating, 2).alias("operating_effectiveness"),
        round_half_up(score, 2).alias("effectiveness_score"),
        F.coalesce(effectiveness_rating(score), F.lit(UNTESTED)).alias("effectiveness_rating"))


def effectiveness_rating(score: Column) -> Column:
    return F.when(score.isNotNull(), ladder(score, EFFECTIVENESS_BANDS, TOP_EFFECTIVENESS))


def risk_controls(risk_control: DataFrame, controls: DataFrame) -> DataFrame:
    """One row per risk and mapped control; type and effectiveness are null for a control that is not described."""
    return risk_control.join(controls, "control_id", "left").select(
        "risk_id", "control_id", "control_type", "effectiveness")


def map_risks_to_controls(risks: DataFrame, risk_control: DataFrame) -> DataFrame:
    """One row per risk with the number of its controls; :func:`risk_controls` has them."""
    counted = risk_control.groupBy("risk_id").agg(F.count("*").alias("control_count"))
    return (risks.select("risk_id").join(counted, "risk_id", "left")
            .select("risk_id", F.coalesce("control_count", F.lit(0)).alias("control_count"),
                    F.when(F.col("control_count") > 0, "Adequate").otherwise("None").alias("control_coverage")))


def mapping_analysis(risks: DataFrame, risk_control: DataFrame) -> DataFrame:
    """One row of counts; zeros for no risks."""
    per_risk = risk_control.groupBy("risk_id").agg(F.count("*").alias("n"))
    joined = risks.select("risk_id").join(per_risk, "risk_id", "left")
    return joined.agg(F.count("*").alias("risks_analyzed"),
                      F.coalesce(F.sum("n"), F.lit(0)).alias("total_controls_mapped"),
                      F.count("n").alias("adequately_controlled"))


def _in_category(risks: DataFrame, category: str | None) -> DataFrame:
    return risks.where(F.col("category") == category) if category else risks


def control_gaps(risks: DataFrame, risk_control: DataFrame, category: str | None = None) -> DataFrame:
    """Risks that no control covers."""
    covered = risk_control.select("risk_id").distinct()
    gaps = _in_category(risks, category).join(covered, "risk_id", "left_anti")
    return gaps.select(
        "risk_id", F.lit(category or "all").alias("risk_category"), "category",
        F.col("level").alias("risk_exposure"),
        F.when(F.col("level") == "High", "Critical").when(F.col("level") == "Medium", "High").otherwise("Medium")
        .alias("priority"))


def control_coverage(risks: DataFrame, risk_control: DataFrame, category: str | None = None) -> DataFrame:
    """Risks, covered risks and their percentage (null when there are none)."""
    covered = risk_control.select("risk_id").distinct().withColumn("_covered", F.lit(1))
    joined = _in_category(risks, category).join(covered, "risk_id", "left")
    return joined.agg(
        F.lit(category or "all").alias("risk_category"),
        F.count("*").alias("total_risks"),
        F.count("_covered").alias("risks_with_controls"),
        round_half_up(F.try_divide(F.count("_covered"), F.count("*")) * 100, 4).alias("coverage_percentage"))


def rcsa_summary(risks: DataFrame, rated_controls: DataFrame, actions: DataFrame, by: str = "business_unit",
                 period: str | None = None, include_remediation: bool = True) -> DataFrame:
    """Counts of risks by level, controls by rating and actions by status per unit.

    ``rated_controls`` carries ``effectiveness_rating``. Without remediation the
    three action columns are null and the actions are not read.
    """
    def counts(df: DataFrame, column: str, names: dict[str, str], total: str | None = None) -> DataFrame:
        aggs = [F.count_if(F.col(column) == value).alias(name) for name, value in names.items()]
        if total:
            aggs.insert(0, F.count("*").alias(total))
        return df.groupBy(by).agg(*aggs)

    summary = counts(risks, "level", {"high_risks": "High", "medium_risks": "Medium", "low_risks": "Low"}, "total_risks")
    rated = counts(rated_controls, "effectiveness_rating",
                   {"effective_controls": "Effective", "partially_effective": "Partially Effective",
                    "ineffective": "Ineffective"}, "total_controls")
    summary = summary.join(rated, by, "full")
    statuses = {"open_actions": "open", "overdue_actions": "overdue", "completed_this_period": "completed"}
    if include_remediation:
        summary = summary.join(counts(actions, "status", statuses), by, "full")
    filled = summary.select(by, F.lit(period or DEFAULT_SUMMARY_PERIOD).alias("period"),
                            *[F.coalesce(c, F.lit(0)).alias(c) for c in summary.columns if c != by])
    if not include_remediation:
        filled = filled.select("*", *[F.lit(None).cast("long").alias(s) for s in statuses])
    return filled


def kri_status(measures: DataFrame, amber: float, red: float, period: str = "period_start") -> DataFrame:
    """Status and trend of each indicator and period; higher values are worse."""
    order = Window.partitionBy("business_unit", "kri").orderBy(period)
    previous = F.col("_previous")
    value = F.col("_value")
    return (measures.withColumn("_value", round_half_up(F.col("value"), 6))
            .withColumn("_previous", F.lag("_value").over(order))
            .select("business_unit", "kri", period,
                    value.alias("value"),
                    F.when(value >= red, "Red").when(value >= amber, "Amber").otherwise("Green").alias("status"),
                    F.when(value < previous, "Improving").when(value > previous, "Deteriorating")
                    .otherwise("Stable").alias("trend")))
