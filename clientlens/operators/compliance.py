"""Compliance checks, regulatory thresholds, alerts and report drafts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens.common import round_half_up
from clientlens.functions.scores import ladder, risk_level
from clientlens.sources import dimensions

# Monitoring thresholds, review cycle and filing deadline.
HIGH_VALUE = 100_000
SUSPICIOUS = 50_000
REVIEW_MONTHS = 12
FILING_DAYS = 15
DEFAULT_JURISDICTION = "SG"
CHECK_SECTIONS = ("kyc", "sanctions", "pep", "aml")

REQUIRED_DOCUMENTS = ("passport", "utility_bill", "bank_statement", "source_of_wealth_declaration")
# Who must have signed a report.
SIGNED_FIELDS = ("authorized_signatory", "compliance_officer_review")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def kyc_status(kyc: DataFrame, as_of: str, required: Sequence[str] = REQUIRED_DOCUMENTS) -> DataFrame:
    """Verification state per customer, with overdue reviews and missing documents flagged."""
    today = F.lit(as_of).cast("date")
    following = F.add_months("last_verification", REVIEW_MONTHS)
    missing = F.array_except(_strings(required), F.col("documents_on_file"))
    return (kyc.withColumn("next_review_date", following)
            .withColumn("missing_documents", missing)
            .withColumn("verification_flags", F.array_compact(F.array(
                F.when(F.col("next_review_date") < today, "review_overdue"),
                F.when(F.size("missing_documents") > 0, "documents_missing"))))
            .select(
                "customer_id",
                F.when(F.col("next_review_date") < today, "expired").otherwise("verified").alias("kyc_status"),
                F.when(F.size("missing_documents") == 0, "enhanced").otherwise("standard").alias("verification_level"),
                F.col("last_verification").alias("last_verification_date"),
                "next_review_date", "documents_on_file", "missing_documents", "verification_flags",
                ladder(F.col("risk_rating"), ((3, "low"), (4, "medium")), "high").alias("risk_tier")))


def regulatory_limits(transactions: DataFrame, jurisdiction: str | None = "jurisdiction", amount: str = "amount",
                      thresholds: DataFrame | None = None) -> DataFrame:
    """Every reporting threshold a transaction reaches, in table order.

    The thresholds of a jurisdiction are held as one array, so each transaction
    is decided in its own row: the fixed dimension is broadcast and nothing is
    shuffled. A missing jurisdiction means the default one; an unknown one has a
    single CTR threshold.
    """
    fixed = thresholds is None
    table = dimensions.thresholds(transactions.sparkSession) if fixed else thresholds
    rules = table.groupBy(F.col("jurisdiction").alias("_rules_for")).agg(
        F.sort_array(F.collect_list(F.struct("ord", "report_type", "threshold"))).alias("_rules"))
    default = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("report_type"), F.lit(t).alias("threshold"))
                        for i, (k, t) in enumerate(dimensions.DEFAULT_THRESHOLDS)])
    where = F.coalesce(F.col(jurisdiction), F.lit(DEFAULT_JURISDICTION)) if jurisdiction else F.lit(DEFAULT_JURISDICTION)
    value = F.col(amount)

    def alert(rule):
        return F.struct(
            rule["report_type"].alias("report_type"), rule["threshold"].alias("threshold"),
            (value - rule["threshold"]).alias("exceeded_by"),
            F.concat(F.lit("File "), rule["report_type"], F.lit(" within regulatory timeframe")).alias("action_required"))

    placed = transactions.withColumn("_where", where)
    joined = placed.join(F.broadcast(rules) if fixed else rules, F.col("_where") == F.col("_rules_for"), "left")
    return (joined.withColumn("_rules", F.coalesce("_rules", default))
            .withColumn("thresholds_checked", F.transform("_rules", lambda r: F.struct(r["report_type"], r["threshold"])))
            .withColumn("alerts", F.transform(F.filter("_rules", lambda r: value >= r["threshold"]), alert))
            .withColumn("reporting_required", F.size("alerts") > 0)
            .withColumn("recommendation", F.coalesce(F.get("alerts", F.lit(0))["action_required"],
                                                     F.lit("No reporting required")))
            .drop("_where", "_rules_for", "_rules"))


def alert_columns(amount: Column, high: float, suspicious: float) -> tuple[Column, Column]:
    """Alert type (null below both thresholds) and a 0-100 score that is 50 at ``high``."""
    kind = F.when(amount >= high, "HIGH_VALUE").when(amount >= suspicious, "SUSPICIOUS")
    return kind, round_half_up(F.least(F.lit(100.0), amount / high * 50), 2)


def transaction_alerts(transactions: DataFrame, high: float = HIGH_VALUE, suspicious: float = SUSPICIOUS) -> DataFrame:
    """One alert per transaction at or above a threshold; the filter reaches the scan."""
    kind, score = alert_columns(F.col("amount"), high, suspicious)
    return transactions.where(F.col("amount") >= min(high, suspicious)).select(
        F.concat(F.lit("ALERT-"), F.col("transaction_id").cast("string")).alias("alert_id"),
        "customer_id", "transaction_id", kind.alias("alert_type"), score.alias("risk_score"),
        "amount", "currency",
        F.concat(kind, F.lit(" transaction of customer "), F.col("customer_id").cast("string")).alias("description"),
        F.col("ts").alias("created_at"), F.lit("OPEN").alias("status"))


def _report_id(as_of: str) -> Column:
    return F.concat(F.lit("SAR-"), F.date_format(F.lit(as_of).cast("date"), "yyyyMMdd"), F.lit("-"),
                    F.col("customer_id").cast("string"))


def sar_transactions(alerts: DataFrame, as_of: str) -> DataFrame:
    """The transactions of each draft report, one per row and without repeats."""
    return (alerts.where(F.col("transaction_id").isNotNull()).select("customer_id", "transaction_id").distinct()
            .select(_report_id(as_of).alias("report_id"), "customer_id", "transaction_id"))


def sar_drafts(alerts: DataFrame, as_of: str, narratives: DataFrame | None = None, jurisdiction: str | None = None,
               regulatory_body: str | None = None) -> DataFrame:
    """One draft report per customer with the number of its transactions (:func:`sar_transactions` has them).

    ``narratives`` holds customer_id and, as far as they are known, narrative and
    the fields of SIGNED_FIELDS. What a draft lacks is listed in
    ``missing_fields``.
    """
    today = F.lit(as_of).cast("date")
    found = sar_transactions(alerts, as_of).groupBy("customer_id").agg(F.count("*").alias("transaction_count"))
    drafts = alerts.select("customer_id").distinct().join(found, "customer_id", "left")
    given = () if narratives is None else narratives.columns
    fields = [f for f in ("narrative", *SIGNED_FIELDS) if f in given]
    if fields:
        drafts = drafts.join(narratives.select("customer_id", *fields), "customer_id", "left")
    value = {f: F.coalesce(F.col(f).cast("string"), F.lit("")) if f in fields else F.lit("") for f in ("narrative", *SIGNED_FIELDS)}
    count = F.coalesce("transaction_count", F.lit(0))
    missing = F.array_compact(F.array(
        F.when(value["narrative"] == "", "narrative"), F.when(count == 0, "transactions"),
        *(F.when(value[f] == "", f) for f in SIGNED_FIELDS)))
    return drafts.select(
        _report_id(as_of).alias("report_id"), F.lit("DRAFT").alias("status"), "customer_id",
        count.alias("transaction_count"), value["narrative"].alias("narrative"),
        F.lit(jurisdiction).cast("string").alias("jurisdiction"), F.lit(regulatory_body).cast("string").alias("regulatory_body"),
        F.date_add(today, FILING_DAYS).alias("filing_deadline"),
        (F.size(missing) == 0).alias("required_fields_complete"), missing.alias("missing_fields"))


def aml_indicators(transactions: DataFrame, high: float = HIGH_VALUE) -> DataFrame:
    """Per customer: share of high-value transactions as a score, its level, and their number."""
    sums = transactions.groupBy("customer_id").agg(
        F.count("*").alias("_n"), F.count_if(F.col("amount") >= high).alias("alerts_pending"))
    score = round_half_up(F.col("alerts_pending") * 100 / F.col("_n"), 2)
    return (sums.withColumn("risk_score", score).withColumn("risk_level", risk_level(F.col("risk_score")))
            .select("customer_id", "risk_score", "risk_level", "alerts_pending"))


def compliance_check(customers: DataFrame, kyc: DataFrame | None = None, sanctions: DataFrame | None = None,
                     pep: DataFrame | None = None, aml: DataFrame | None = None, check_type: str = "full",
                     as_of: str | None = None) -> DataFrame:
    """The sections asked for, and CLEAR when none of them raises a flag.

    Inputs have one row per customer: :func:`kyc_status`, a sanctions table with
    ``matches_found``, a PEP table with ``pep_status`` and ``related_pep``, and
    :func:`aml_indicators`. A section that was not asked for is not joined.
    """
    sections = {"kyc": kyc, "sanctions": sanctions, "pep": pep, "aml": aml}
    fields = {
        "kyc": F.struct(F.col("kyc_status").alias("status"), F.col("last_verification_date").alias("verification_date"),
                        (F.size("missing_documents") == 0).alias("documents_valid"),
                        F.col("next_review_date").alias("next_review")),
        "sanctions": F.struct(F.when(F.col("matches_found") > 0, "match").otherwise("clear").alias("status"),
                              F.col("matches_found")),
        "pep": F.struct(F.col("pep_status").alias("is_pep"), F.col("related_pep")),
        "aml": F.struct("risk_score", "risk_level", "alerts_pending"),
    }
    flagged = {
        "kyc": lambda s: s["status"] != "verified",
        "sanctions": lambda s: s["matches_found"] > 0,
        "pep": lambda s: s["is_pep"] | s["related_pep"],
        "aml": lambda s: s["risk_level"].isin("HIGH", "CRITICAL"),
    }
    result = customers.select("customer_id", F.lit(check_type).alias("check_type"), F.lit(as_of).alias("timestamp"))
    flags = F.lit(False)
    for name in CHECK_SECTIONS:
        if check_type in (name, "full") and sections[name] is not None:
            result = result.join(sections[name].select("customer_id", fields[name].alias(name)), "customer_id", "left")
            flags = flags | F.coalesce(flagged[name](F.col(name)), F.lit(False))
    return result.withColumn("overall_status", F.when(flags, "REVIEW").otherwise("CLEAR"))
