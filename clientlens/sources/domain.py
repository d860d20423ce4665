"""Domain views over the star schema (definitions in FIXTURES.md)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.common import round_half_up
from clientlens.sources.tables import load_table

AS_OF = "2001-08-01"
CURRENCIES = ("USD", "EUR", "GBP", "SGD", "AUD", "JPY")
JURISDICTIONS = ("SG", "US", "UK", "EU", "HK")
TRANSACTION_TYPES = ("credit", "debit", "transfer", "trade")
LISTS = ("OFAC", "UN", "EU", "UK_HMT", "SG_MAS")
KYC_DOCUMENTS = ("passport", "utility_bill", "bank_statement", "source_of_wealth_declaration")
LARGE_AMOUNT = 100_000


def pick(values, number: Column) -> Column:
    """values[number % len(values)]"""
    options = F.array(*[F.lit(v) for v in values])
    return F.element_at(options, (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def customers(spark: SparkSession, directory: str) -> DataFrame:
    c = load_table(spark, directory, "customer")
    return c.select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("name"),
        (F.col("c_custkey") % 5 + 1).cast("int").alias("risk_rating"),
        F.col("c_acctbal").alias("account_balance"),
        pick(CURRENCIES, F.col("c_nationkey")).alias("preferred_currency"),
        pick(JURISDICTIONS, F.col("c_nationkey")).alias("jurisdiction"),
    )


def customer_profile_view(spark: SparkSession, directory: str) -> DataFrame:
    """``customers`` with the date of the first order."""
    since = (load_table(spark, directory, "orders").groupBy(F.col("o_custkey").alias("customer_id"))
             .agg(F.min("o_orderdate").cast("date").alias("customer_since")))
    return customers(spark, directory).join(since, "customer_id", "left")


def unit_trust(spark: SparkSession, directory: str) -> DataFrame:
    p = load_table(spark, directory, "part")
    key = F.col("p_partkey")
    return p.select(
        key.alias("product_id"),
        F.col("p_name").alias("product_name"),
        (F.col("p_size") % 5 + 1).cast("int").alias("risk_rating"),
        F.when(key % 97 == 0, "XXX").otherwise(pick(CURRENCIES, key)).alias("currency"),
        F.col("p_retailprice").alias("nav"),
        (F.lit(0.5) + (key % 100) / 100).alias("expense_ratio"),
        F.col("p_type").alias("asset_class"),
    )


def transactions(spark: SparkSession, directory: str) -> DataFrame:
    o = load_table(spark, directory, "orders")
    return o.select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        pick(TRANSACTION_TYPES, F.col("o_orderkey")).alias("type"),
        pick(CURRENCIES, F.col("o_custkey")).alias("currency"),
        pick(JURISDICTIONS, F.col("o_custkey")).alias("jurisdiction"),
    )


def holdings(spark: SparkSession, directory: str) -> DataFrame:
    """Value bought per customer and product."""
    line = load_table(spark, directory, "lineitem")
    order = load_table(spark, directory, "orders")
    return (line.join(order, line["l_orderkey"] == order["o_orderkey"])
            .groupBy(F.col("o_custkey").alias("customer_id"), F.col("l_partkey").alias("product_id"))
            .agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value")))


def product_holdings(spark: SparkSession, directory: str) -> DataFrame:
    """``holdings`` with the product's asset class and risk rating."""
    products = unit_trust(spark, directory).select("product_id", "asset_class", "risk_rating")
    return holdings(spark, directory).join(products, "product_id")


def risk_factors(spark: SparkSession, directory: str) -> DataFrame:
    """The six scores behind the customer risk score."""
    bought = (product_holdings(spark, directory).groupBy("customer_id")
              .agg(F.avg("risk_rating").alias("avg_risk")))
    activity = (load_table(spark, directory, "orders").groupBy(F.col("o_custkey").alias("customer_id"))
                .agg(F.avg(F.when(F.col("o_totalprice") >= LARGE_AMOUNT, 1).otherwise(0)).alias("large_share")))
    key = F.col("customer_id")
    base = load_table(spark, directory, "customer").select(F.col("c_custkey").alias("customer_id"), "c_nationkey")
    return (base.join(bought, "customer_id", "left").join(activity, "customer_id", "left").select(
        "customer_id",
        (F.col("c_nationkey") % 21).cast("double").alias("geographic_risk"),
        round_half_up(F.coalesce("avg_risk", F.lit(0.0)) * 4, 2).alias("product_risk"),
        (key % 13).cast("double").alias("channel_risk"),
        (key % 17).cast("double").alias("customer_type_risk"),
        (key % 11).cast("double").alias("tenure_risk"),
        round_half_up(F.coalesce("large_share", F.lit(0.0)) * 20, 2).alias("transaction_behavior_risk"),
    ))


def kyc(spark: SparkSession, directory: str) -> DataFrame:
    c = load_table(spark, directory, "customer")
    key = F.col("c_custkey")
    documents = F.array(*[F.lit(d) for d in KYC_DOCUMENTS])
    return c.select(
        key.alias("customer_id"),
        F.date_sub(F.lit(AS_OF).cast("date"), (key % 500).cast("int")).alias("last_verification"),
        F.slice(documents, F.lit(1), (key % 3 + 2).cast("int")).alias("documents_on_file"),
        (key % 5 + 1).cast("int").alias("risk_rating"),
    )


def watchlist(spark: SparkSession, directory: str) -> DataFrame:
    """Every supplier as a listed party under a changed spelling."""
    s = load_table(spark, directory, "supplier")
    key = F.col("s_suppkey")
    return s.select(
        key.alias("entry_id"),
        F.concat(F.lit("CUSTOMER  "), F.substring("s_name", 10, 9)).alias("listed_name"),
        pick(LISTS, key).alias("list_name"),
        pick(JURISDICTIONS, F.col("s_nationkey")).alias("country"),
    )


def pep_list(spark: SparkSession, directory: str) -> DataFrame:
    """Suppliers with a high balance as politically exposed persons."""
    s = load_table(spark, directory, "supplier")
    return s.where(F.col("s_acctbal") >= 9000).select(
        F.col("s_suppkey").alias("pep_id"),
        F.concat(F.lit("customer-"), F.substring("s_name", 10, 9)).alias("pep_name"),
        pick(("government", "military", "judiciary"), F.col("s_nationkey")).alias("category"),
    )


def relations(spark: SparkSession, directory: str) -> DataFrame:
    """customer_id → related party name, from the suppliers behind the orders."""
    line = load_table(spark, directory, "lineitem").select("l_orderkey", "l_suppkey")
    order = load_table(spark, directory, "orders").select("o_orderkey", "o_custkey")
    pairs = (line.join(order, line["l_orderkey"] == order["o_orderkey"])
             .groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("strength")))
    supplier = load_table(spark, directory, "supplier").select("s_suppkey", "s_name")
    return (pairs.join(supplier, pairs["l_suppkey"] == supplier["s_suppkey"])
            .select(F.col("o_custkey").alias("customer_id"),
                    F.concat(F.lit("Customer#"), F.substring("s_name", 10, 9)).alias("related_name"),
                    "strength"))


def risks(spark: SparkSession, directory: str) -> DataFrame:
    p = load_table(spark, directory, "part")
    return p.select(
        F.col("p_partkey").alias("risk_id"),
        F.col("p_type").alias("category"),
        F.when(F.col("p_size") <= 20, "Low").when(F.col("p_size") <= 40, "Medium").otherwise("High").alias("level"),
        (F.col("p_partkey") % 25).cast("int").alias("business_unit"),
    )


def controls(spark: SparkSession, directory: str) -> DataFrame:
    s = load_table(spark, directory, "supplier")
    key = F.col("s_suppkey")
    return s.select(
        key.alias("control_id"),
        F.col("s_nationkey").alias("business_unit"),
        (key % 41 + 60).cast("double").alias("design_score"),
        pick(("Preventive", "Detective"), key).alias("control_type"),
    )


def risk_control(spark: SparkSession, directory: str) -> DataFrame:
    """Which control covers which risk (distinct pairs of the largest orders)."""
    line = load_table(spark, directory, "lineitem")
    return (line.where(F.col("l_quantity") >= 48)
            .select(F.col("l_partkey").alias("risk_id"), F.col("l_suppkey").alias("control_id")).distinct())


def period_label(ts: Column) -> Column:
    """'Q4 2000'"""
    return F.concat(F.lit("Q"), F.quarter(ts).cast("string"), F.lit(" "), F.year(ts).cast("string"))


def control_tests(spark: SparkSession, directory: str) -> DataFrame:
    line = load_table(spark, directory, "lineitem")
    return line.select(
        F.col("l_suppkey").alias("control_id"),
        (F.col("l_returnflag") == "R").alias("exception"),
        (F.col("l_linestatus") == "O").alias("pending"),
        period_label(F.col("l_shipdate")).alias("period"),
        F.trunc("l_shipdate", "quarter").alias("period_start"),
    )


def kri_measures(spark: SparkSession, directory: str) -> DataFrame:
    """Two indicators per business unit and quarter."""
    tests = control_tests(spark, directory)
    units = controls(spark, directory).select("control_id", "business_unit")
    per_control = (tests.groupBy("control_id", "period_start").agg(
        F.count("*").alias("n"), F.count_if("exception").alias("exceptions"), F.count_if("pending").alias("pending")))
    per_unit = (per_control.join(units, "control_id").groupBy("business_unit", "period_start").agg(
        (F.sum("exceptions") / F.sum("n")).alias("Control Exceptions"),
        (F.sum("pending") / F.sum("n")).alias("Pending Items")))
    return per_unit.unpivot(["business_unit", "period_start"], ["Control Exceptions", "Pending Items"], "kri", "value")


def remediation_actions(spark: SparkSession, directory: str) -> DataFrame:
    o = load_table(spark, directory, "orders")
    return o.select(
        F.col("o_orderkey").alias("action_id"),
        (F.col("o_custkey") % 25).cast("int").alias("business_unit"),
        F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "completed")
        .otherwise("overdue").alias("status"),
    )


def residual_input(spark: SparkSession, directory: str) -> DataFrame:
    p = load_table(spark, directory, "part")
    return p.select(
        F.col("p_partkey").alias("risk_id"),
        (F.col("p_size") % 6).cast("double").alias("inherent_risk_score"),
        (F.col("p_partkey") % 101).cast("double").alias("control_effectiveness"),
    )


def _node(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def edges(spark: SparkSession, directory: str) -> DataFrame:
    """(src, rel, dst) from the foreign keys."""
    order = load_table(spark, directory, "orders")
    line = load_table(spark, directory, "lineitem")
    customer = load_table(spark, directory, "customer")
    supplier = load_table(spark, directory, "supplier")
    nation = load_table(spark, directory, "nation")

    def links(df, src, rel, dst):
        return df.select(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"))

    return (
        links(order, _node("C", "o_custkey"), "PLACED", _node("O", "o_orderkey"))
        .unionAll(links(line, _node("O", "l_orderkey"), "CONTAINS", _node("P", "l_partkey")))
        .unionAll(links(line, _node("P", "l_partkey"), "SUPPLIED_BY", _node("S", "l_suppkey")))
        .unionAll(links(customer, _node("C", "c_custkey"), "IN", _node("N", "c_nationkey")))
        .unionAll(links(supplier, _node("S", "s_suppkey"), "IN", _node("N", "s_nationkey")))
        .unionAll(links(nation, _node("N", "n_nationkey"), "IN", _node("R", "n_regionkey")))
    )


def nodes(spark: SparkSession, directory: str) -> DataFrame:
    """(id, type, properties)."""
    def rows(table, prefix, key, kind, label):
        return load_table(spark, directory, table).select(
            _node(prefix, key).alias("id"), F.lit(kind).alias("type"),
            F.create_map(F.lit("name"), F.col(label).cast("string")).alias("properties"))

    return (
        rows("customer", "C", "c_custkey", "customer", "c_name")
        .unionAll(rows("orders", "O", "o_orderkey", "order", "o_orderkey"))
        .unionAll(rows("part", "P", "p_partkey", "product", "p_name"))
        .unionAll(rows("supplier", "S", "s_suppkey", "supplier", "s_name"))
        .unionAll(rows("nation", "N", "n_nationkey", "nation", "n_name"))
        .unionAll(rows("region", "R", "r_regionkey", "region", "r_name"))
    )


def audit_columns(events: DataFrame) -> DataFrame:
    """Event rows under the audit record's column names (batch or stream)."""
    return events.select(
        F.col("event_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_type").alias("action"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("user_id").cast("string").alias("customer_id"),
        F.col("props").alias("details"),
        F.lit(None).cast("string").alias("ip_address"),
        F.lit(None).cast("string").alias("session_id"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.col("value").alias("execution_time_ms"),
    )


def audit_log(spark: SparkSession, directory: str) -> DataFrame:
    return audit_columns(load_table(spark, directory, "events"))


def finance_text(spark: SparkSession, directory: str) -> DataFrame:
    """One short business note per order, with money, dates and personal data."""
    o = load_table(spark, directory, "orders")
    order, customer = F.col("o_orderkey"), F.col("o_custkey")

    def digits(number: Column, width: int) -> Column:
        return F.lpad(number.cast("string"), width, "0")

    topic = pick(("Refund of the fund", "KYC file checked", "Transaction booked", "Risk reviewed", "Note"), order)
    return o.select(
        order.alias("doc_id"),
        F.concat(
            topic, F.lit(" for client "), customer.cast("string"),
            F.lit(".\nAmount $"), F.format_number("o_totalprice", 2),
            F.lit(" on "), F.date_format("o_orderdate", "MM/dd/yyyy"),
            F.lit(" at "), (order % 40).cast("string"), F.lit("."), (order % 10).cast("string"), F.lit("%.\n"),
            F.lit("Write to client."), customer.cast("string"), F.lit("@bank"), (order % 7).cast("string"),
            F.lit(".com or call "), digits(order % 800 + 200, 3), F.lit("-"), digits(customer % 900, 3), F.lit("-"),
            digits(order % 10000, 4),
            F.lit(".\nSSN "), digits(customer % 1000, 3), F.lit("-"), digits(order % 100, 2), F.lit("-"),
            digits(order % 9999, 4),
            F.lit(", account "), digits(customer, 11),
            F.lit(", card "), digits(order % 10000, 4), F.lit(" 5500 "), digits(customer % 10000, 4), F.lit(" 0042."),
        ).alias("text"),
        F.col("o_orderstatus").alias("source"),
    )


def doc_pairs(spark: SparkSession, directory: str) -> DataFrame:
    """Each document with the next one of the collection, as id pairs."""
    d = load_table(spark, directory, "documents")
    return d.select(F.col("doc_id").alias("doc_a"), (F.col("doc_id") + 1).alias("doc_b"))


def product_prices(spark: SparkSession, directory: str) -> DataFrame:
    """Average unit price per product and month."""
    line = load_table(spark, directory, "lineitem")
    return (line.groupBy(F.col("l_partkey").alias("product_id"), F.trunc("l_shipdate", "month").alias("month"))
            .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price")))


def label_centroids(spark: SparkSession, directory: str) -> DataFrame:
    """Mean embedding per label: the query vectors of the search examples."""
    e = load_table(spark, directory, "embeddings")
    means = (e.select("label", F.posexplode("embedding").alias("pos", "x"))
             .groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("mean")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"])
    return means.groupBy(F.col("label").alias("query_id")).agg(ordered.alias("embedding"))


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "customers": customers,
    "customer_profile": customer_profile_view,
    "unit_trust": unit_trust,
    "transactions": transactions,
    "holdings": holdings,
    "product_holdings": product_holdings,
    "risk_factors": risk_factors,
    "kyc": kyc,
    "watchlist": watchlist,
    "pep_list": pep_list,
    "relations": relations,
    "risks": risks,
    "controls": controls,
    "risk_control": risk_control,
    "control_tests": control_tests,
    "kri_measures": kri_measures,
    "remediation_actions": remediation_actions,
    "residual_input": residual_input,
    "edges": edges,
    "nodes": nodes,
    "audit_log": audit_log,
    "finance_text": finance_text,
    "doc_pairs": doc_pairs,
    "product_prices": product_prices,
    "label_centroids": label_centroids,
}


def register_domain_views(spark: SparkSession, directory: str) -> list[str]:
    """Name every domain view in the session; nothing is computed."""
    for name, build in VIEWS.items():
        build(spark, directory).createOrReplaceTempView(name)
    return list(VIEWS)
