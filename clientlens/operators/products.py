"""Product search, suitability, comparison and currency conversion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens.common import round_half_up, top_n_per
from clientlens.sources.dimensions import FX_RATES

# Fixed value: searches return 5 rows unless told otherwise.
DEFAULT_RESULTS = 5


def ranked_results(matches: DataFrame, score: str, key: str, limit: int) -> DataFrame:
    """The best ``limit`` rows, each with the number of matches before the limit.

    The total is a scalar subquery: no window over the whole table.
    """
    total = matches.agg(F.count("*").alias("n")).scalar()
    return (matches.orderBy(F.desc(score), F.asc(key)).limit(limit)
            .withColumn("total_results", total))


def search_products(products: DataFrame, scores: DataFrame, max_risk_rating: int | None = None,
                    currency: str | None = None, limit: int = DEFAULT_RESULTS) -> DataFrame:
    """Scored products under the risk and currency filters (0 and '' mean none)."""
    if max_risk_rating:
        products = products.where(F.col("risk_rating") <= max_risk_rating)
    if currency:
        products = products.where(F.col("currency") == currency)
    matches = products.join(scores.select("product_id", "relevance_score"), "product_id")
    return ranked_results(matches, "relevance_score", "product_id", limit)


def best_per_level(products: DataFrame, n: int) -> DataFrame:
    """For each rating that products have: the ``n`` best products at or below it, and how many there are.

    The best per own rating are found first, so at most ratings·n rows reach the
    second ranking. ``levels`` lists the ratings, for customers to find theirs.
    """
    order = [F.asc("expense_ratio"), F.asc("product_id")]
    rated = products.where(F.col("risk_rating").isNotNull())
    levels = rated.agg(F.sort_array(F.collect_set("risk_rating"))).scalar()

    def at_or_above(df: DataFrame) -> DataFrame:
        return (df.withColumn("levels", levels)
                .withColumn("level", F.explode(F.filter("levels", lambda level: level >= F.col("risk_rating")))))

    own = top_n_per(rated, ["risk_rating"], order, n).drop("rank")
    best = top_n_per(at_or_above(own).drop("levels"), ["level"], order, n)
    totals = (at_or_above(rated.groupBy("risk_rating").agg(F.count("*").alias("products")))
              .groupBy("level").agg(F.sum("products").alias("suitable_products")))
    return best.join(totals, "level")


def suitable_products(customers: DataFrame, products: DataFrame, n: int = DEFAULT_RESULTS,
                      keep: Sequence[str] = ()) -> DataFrame:
    """The ``n`` cheapest products whose risk does not exceed the customer's.

    Ratings may be any numbers: a customer's level is the highest product rating
    that is not above the customer's own. ``keep`` names further customer columns.

    Customers meet a table of ratings·n rows on their level: no range join.
    """
    best = best_per_level(products, n).select(
        "level", "product_id", "product_name", "risk_rating", "expense_ratio", "rank", "suitable_products")
    levels = products.agg(F.sort_array(F.collect_set("risk_rating"))).scalar()
    asked = customers.select("customer_id", *keep, F.col("risk_rating").alias("_own")).withColumn("_levels", levels)
    placed = asked.withColumn("level", F.array_max(F.filter("_levels", lambda level: level <= F.col("_own"))))
    return placed.drop("_levels", "_own").join(best, "level").drop("level")


def assess_suitability(pairs: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Status, warnings and disclosures for given (customer_id, product_id) pairs.

    A pair whose customer or product, or its rating, is not known is UNKNOWN.
    """
    who = customers.select("customer_id", F.col("risk_rating").alias("_customer_risk"),
                           F.col("preferred_currency").alias("_wanted"))
    what = products.select("product_id", F.col("risk_rating").alias("_product_risk"),
                           F.col("currency").alias("_currency"))
    joined = pairs.join(who, "customer_id", "left").join(what, "product_id", "left")
    match = F.col("_product_risk") <= F.col("_customer_risk")
    other_currency = F.col("_currency") != F.col("_wanted")
    considered = F.array_compact(F.array(
        F.when(match.isNotNull(), "risk ratings of customer and product"),
        F.when(other_currency.isNotNull(), "currencies of customer and product")))
    return joined.select(
        "customer_id", "product_id",
        F.when(match, "SUITABLE").when(~match, "NOT_SUITABLE").otherwise("UNKNOWN").alias("suitability_status"),
        match.alias("risk_match"),
        considered.alias("factors_considered"),
        F.array_compact(F.array(
            F.when(~match, "Product risk exceeds customer risk rating"),
            F.when(other_currency, "Product currency differs from preferred currency"))).alias("warnings"),
        F.array_compact(F.array(
            F.lit("Product risk disclosure"),
            F.when(other_currency, "Currency risk disclosure"))).alias("disclosures_required"))


def product_metrics(products: DataFrame, prices: DataFrame, as_of: str) -> DataFrame:
    """Risk, cost, one-year return and volatility per product.

    The return compares the mean of the last twelve monthly prices with the mean
    of the twelve before; volatility is the monthly deviation over the mean.
    """
    until = F.lit(as_of).cast("date")
    year, month = F.add_months(until, -12), F.col("month")
    stats = prices.groupBy("product_id").agg(
        F.avg(F.when(month > year, F.col("price"))).alias("_now"),
        F.avg(F.when((month <= year) & (month > F.add_months(until, -24)), F.col("price"))).alias("_then"),
        F.try_divide(F.stddev_samp("price"), F.avg("price")).alias("_spread"))
    return products.join(stats, "product_id", "left").select(
        "product_id",
        F.col("risk_rating").cast("double").alias("risk_rating"),
        "expense_ratio",
        round_half_up((F.try_divide(F.col("_now"), F.col("_then")) - 1) * 100, 4).alias("1y_return"),
        round_half_up(F.col("_spread"), 4).alias("volatility"))


METRICS = ("risk_rating", "expense_ratio", "1y_return", "volatility")


def compare_products(metrics: DataFrame, ids: DataFrame | Sequence) -> DataFrame:
    """Metric × product values in rows (metric, product_id, value) for any number of products."""
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col(ids.columns[0]).alias("product_id")).distinct()
        chosen = metrics.join(wanted, "product_id", "left_semi")
    else:
        chosen = metrics.where(F.col("product_id").isin(list(ids)))
    return chosen.unpivot(["product_id"], list(METRICS), "metric", "value")


def comparison_matrix(metrics: DataFrame, ids: Sequence) -> DataFrame:
    """The comparison as a matrix: one row per metric, one column per given product."""
    return (compare_products(metrics, ids).groupBy("metric").pivot("product_id", list(ids)).agg(F.first("value")))


def convert_currency(df: DataFrame, amount: str, from_currency: str | Column, to_currency: str | Column | None = None,
                     rates: DataFrame | None = None) -> DataFrame:
    """Amounts in another currency; a code without a rate counts as 1.0.

    Codes are matched in upper case and echoed as given. The built-in rates are
    a map inside the expression; a caller's table is joined as AQE sees fit.
    """
    source = F.col(from_currency) if isinstance(from_currency, str) else from_currency
    target = F.lit("USD") if to_currency is None else (F.col(to_currency) if isinstance(to_currency, str) else to_currency)
    coded = df.withColumn("original_currency", source).withColumn("target_currency", target)
    if rates is None:
        fixed = F.create_map(*[F.lit(v) for pair in FX_RATES.items() for v in pair])
        coded = (coded.withColumn("_from_rate", fixed[F.upper("original_currency")])
                 .withColumn("_to_rate", fixed[F.upper("target_currency")]))
    else:
        for end, column in (("_from", "original_currency"), ("_to", "target_currency")):
            side = rates.select(F.col("currency").alias(end), F.col("rate").alias(f"{end}_rate"))
            coded = coded.join(side, F.upper(column) == F.col(end), "left").drop(end)
    from_rate = F.coalesce("_from_rate", F.lit(1.0))
    to_rate = F.coalesce("_to_rate", F.lit(1.0))
    return (coded.withColumn("converted_amount", round_half_up(F.col(amount) / from_rate * to_rate, 2))
            .withColumn("rate_used", round_half_up(to_rate / from_rate, 6))
            .drop("_from_rate", "_to_rate"))
