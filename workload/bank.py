"""Queries over customers, products, compliance, portfolios and controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientlens.common import round_half_up, top_n_per
from clientlens.functions.scores import residual_risk, risk_level
from clientlens.operators import compliance as comp
from clientlens.operators import customers as cust
from clientlens.operators import lookup as look
from clientlens.operators import portfolio as port
from clientlens.operators import products as prod
from clientlens.operators import risk_control as rc
from clientlens.operators import screening as scr
from clientlens.operators.search import text_scores
from clientlens.plans.recommendation import recommend
from clientlens.sources import dimensions as dim
from clientlens.sources import domain as d
from clientlens.sources.tables import load_table
from workload.registry import day, flat, joined, query, stamp

AS_OF = d.AS_OF


# --- sources -----------------------------------------------------------------

@query("SC1_load_table", """
    SELECT l_returnflag, l_linestatus, count(*) AS lines, sum(l_quantity) AS quantity
    FROM lineitem GROUP BY ALL""")
def _(spark, directory):
    return (load_table(spark, directory, "lineitem").groupBy("l_returnflag", "l_linestatus")
            .agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity")))


@query("SC2_register_domain_views", """
    SELECT jurisdiction, preferred_currency, count(*) AS customers,
           strftime(min(customer_since), '%Y-%m-%d') AS first_customer
    FROM customer_profile GROUP BY ALL""")
def _(spark, directory):
    d.register_domain_views(spark, directory)
    return spark.sql("""
        SELECT jurisdiction, preferred_currency, count(*) AS customers,
               date_format(min(customer_since), 'yyyy-MM-dd') AS first_customer
        FROM customer_profile GROUP BY jurisdiction, preferred_currency""")


@query("SC3_dimensions", """
    SELECT t.currency, l.report_type, any_value(f.rate) AS rate, count(*) AS transactions,
           count(*) FILTER (t.amount >= l.threshold) AS reached
    FROM transactions t JOIN fx f ON f.currency = t.currency JOIN limits l ON l.jurisdiction = t.jurisdiction
    GROUP BY t.currency, l.report_type""")
def _(spark, directory):
    tx = d.transactions(spark, directory)
    reached = F.count_if(F.col("amount") >= F.col("threshold"))
    return (tx.join(F.broadcast(dim.fx_rates(spark)), "currency")
            .join(F.broadcast(dim.thresholds(spark)), "jurisdiction")
            .groupBy("currency", "report_type")
            .agg(F.first("rate").alias("rate"), F.count("*").alias("transactions"), reached.alias("reached")))


# --- lookups and filters -------------------------------------------------------

@query("F1_lookup", "SELECT customer_id, name, risk_rating, account_balance FROM customers WHERE risk_rating = 3")
def _(spark, directory):
    return look.lookup(d.customers(spark, directory), "risk_rating", 3,
                       ["customer_id", "name", "risk_rating", "account_balance"])


@query("F1_lookup_many", """
    SELECT customer_id, name FROM customers
    WHERE customer_id IN (SELECT customer_id FROM transactions WHERE amount >= 490000)""")
def _(spark, directory):
    wanted = d.transactions(spark, directory).where(F.col("amount") >= 490000).select("customer_id")
    return look.lookup(d.customers(spark, directory), "customer_id", wanted, ["customer_id", "name"])


_NAMES = "(SELECT c_name AS customer_name FROM customer UNION SELECT s_name FROM supplier)"


def _asked_names(spark, directory):
    return (load_table(spark, directory, "customer").select(F.col("c_name").alias("customer_name"))
            .unionAll(load_table(spark, directory, "supplier").select("s_name")))


@query("F2_customer_profile", f"""
    SELECT n.customer_name, c.customer_id, c.risk_rating, c.account_balance, c.preferred_currency,
           strftime(c.customer_since, '%Y-%m-%d') AS customer_since,
           CASE WHEN c.customer_id IS NULL THEN 'not_found' ELSE 'found' END AS status
    FROM {_NAMES} n LEFT JOIN customer_profile c ON c.name = n.customer_name""")
def _(spark, directory):
    found = cust.customer_profile(d.customer_profile_view(spark, directory), d.transactions(spark, directory),
                                  _asked_names(spark, directory))
    return flat(found, days=["customer_since"], drop=["name", "jurisdiction"])


@query("F2_customer_profile_history", f"""
    SELECT n.customer_name, c.customer_id, h.transaction_count, h.transaction_total,
           strftime(h.last_transaction, '%Y-%m-%d') AS last_transaction,
           CASE WHEN c.customer_id IS NULL THEN 'not_found' ELSE 'found' END AS status
    FROM {_NAMES} n LEFT JOIN customers c ON c.name = n.customer_name
    LEFT JOIN (SELECT customer_id, count(*) AS transaction_count,
                      round(sum(amount)::DECIMAL(38, 7), 2)::DOUBLE AS transaction_total, max(ts) AS last_transaction
               FROM transactions GROUP BY 1) h ON h.customer_id = c.customer_id""")
def _(spark, directory):
    found = cust.customer_profile(d.customers(spark, directory), d.transactions(spark, directory),
                                  _asked_names(spark, directory), include_history=True)
    return flat(found, days=["last_transaction"],
                drop=["name", "jurisdiction", "risk_rating", "account_balance", "preferred_currency"])


_PRODUCT_SCORES = """
    scores AS (
      SELECT product_id, round(dot / (qn * dn), 6) AS relevance_score FROM (
        SELECT t.product_id, sum((1 + ln(t.tf)) * i.idf) AS dot, any_value(q.qn) AS qn, any_value(n.dn) AS dn
        FROM (SELECT product_id, w, count(*) AS tf FROM toks GROUP BY ALL) t
        JOIN idf i ON i.w = t.w
        JOIN (SELECT product_id, sqrt(sum(pow(1 + ln(tf), 2))) AS dn FROM
                (SELECT product_id, w, count(*) AS tf FROM toks GROUP BY ALL) GROUP BY 1) n ON n.product_id = t.product_id
        CROSS JOIN (SELECT sqrt(sum(idf * idf)) AS qn FROM idf) q
        GROUP BY t.product_id)),"""


def _product_search_sql(condition: str, limit: int) -> str:
    return f"""WITH toks AS (SELECT product_id, unnest(string_split(lower(product_name), ' ')) AS w FROM unit_trust),
    idf AS (SELECT w, ln((SELECT count(*) FROM unit_trust) / count(DISTINCT product_id)) AS idf
            FROM toks WHERE w IN ('red', 'widget') GROUP BY w),
    {_PRODUCT_SCORES}
    hits AS (SELECT u.*, s.relevance_score FROM unit_trust u JOIN scores s USING (product_id) WHERE {condition})
    SELECT product_id, product_name, risk_rating, currency, nav, expense_ratio, relevance_score,
           (SELECT count(*) FROM hits) AS total_results
    FROM hits ORDER BY relevance_score DESC, product_id LIMIT {limit}"""


@query("F3_search_products", _product_search_sql("risk_rating <= 3 AND currency = 'USD'", 5))
def _(spark, directory):
    products = d.unit_trust(spark, directory)
    scores = text_scores(products, "red widget", "product_id", "product_name")
    return prod.search_products(products, scores, max_risk_rating=3, currency="USD").drop("asset_class")


@query("F3_search_products_no_filter", _product_search_sql("true", 20))
def _(spark, directory):
    products = d.unit_trust(spark, directory)
    scores = text_scores(products, "red widget", "product_id", "product_name")
    return prod.search_products(products, scores, max_risk_rating=0, currency="", limit=20).drop("asset_class")


@query("F6_transaction_alerts", """
    SELECT 'ALERT-' || transaction_id AS alert_id, customer_id, transaction_id,
           CASE WHEN amount >= 100000 THEN 'HIGH_VALUE' ELSE 'SUSPICIOUS' END AS alert_type,
           round(least(100.0::DOUBLE, amount / 100000 * 50)::DECIMAL(38, 7), 2)::DOUBLE AS risk_score, amount, currency,
           CASE WHEN amount >= 100000 THEN 'HIGH_VALUE' ELSE 'SUSPICIOUS' END || ' transaction of customer ' || customer_id
             AS description,
           strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, 'OPEN' AS status
    FROM transactions WHERE amount >= 50000""")
def _(spark, directory):
    alerts = comp.transaction_alerts(d.transactions(spark, directory))
    return alerts.withColumn("created_at", stamp("created_at"))


def _compliance_inputs(spark, directory):
    customers = d.customers(spark, directory)
    kyc = comp.kyc_status(d.kyc(spark, directory), AS_OF)
    sanctions = scr.screen_names(customers, d.watchlist(spark, directory), max_distance=0).select("customer_id", "matches_found")
    pep = scr.check_pep(customers, d.pep_list(spark, directory), d.relations(spark, directory))
    aml = comp.aml_indicators(d.transactions(spark, directory))
    return customers, kyc, sanctions, pep, aml


_SECTIONS = """
    k AS (SELECT customer_id, CASE WHEN last_verification + INTERVAL 12 MONTH < DATE '2001-08-01' THEN 'expired' ELSE 'verified'
                 END AS kyc_state, strftime(last_verification, '%Y-%m-%d') AS verification_date,
                 len(documents_on_file) = 4 AS documents_valid FROM kyc),
    s AS (SELECT c.customer_id, count(DISTINCT w.list_name || w.country) AS matches_found FROM customers c LEFT JOIN watchlist w
            ON substr(w.listed_name, 11) = substr(c.name, 10) GROUP BY 1),
    p AS (SELECT c.customer_id,
                 EXISTS (FROM pep_list l WHERE substr(l.pep_name, 10) = substr(c.name, 10)) AS is_pep,
                 EXISTS (FROM relations r JOIN pep_list l ON substr(l.pep_name, 10) = substr(r.related_name, 10)
                         WHERE r.customer_id = c.customer_id) AS related_pep FROM customers c),
    a AS (SELECT customer_id, round((count(*) FILTER (amount >= 100000) * 100.0 / count(*))::DECIMAL(38, 7), 2)::DOUBLE AS aml_score,
                 count(*) FILTER (amount >= 100000) AS alerts_pending FROM transactions GROUP BY 1)"""


@query("F7_compliance_check_full", f"""WITH {_SECTIONS}
    SELECT c.customer_id, 'full' AS check_type, k.kyc_state, k.verification_date, k.documents_valid, s.matches_found,
           p.is_pep, p.related_pep, a.aml_score, a.alerts_pending,
           CASE WHEN k.kyc_state <> 'verified' OR s.matches_found > 0 OR p.is_pep OR p.related_pep OR coalesce(a.aml_score >= 50, false)
                THEN 'REVIEW' ELSE 'CLEAR' END AS overall_status
    FROM customers c JOIN k USING (customer_id) JOIN s USING (customer_id) JOIN p USING (customer_id)
    LEFT JOIN a USING (customer_id)""")
def _(spark, directory):
    customers, kyc, sanctions, pep, aml = _compliance_inputs(spark, directory)
    checked = comp.compliance_check(customers, kyc, sanctions, pep, aml, "full", AS_OF)
    return checked.select("customer_id", "check_type", F.col("kyc.status").alias("kyc_state"),
                          day("kyc.verification_date").alias("verification_date"), "kyc.documents_valid",
                          "sanctions.matches_found", "pep.is_pep", "pep.related_pep",
                          F.col("aml.risk_score").alias("aml_score"), "aml.alerts_pending", "overall_status")


@query("F7_compliance_check_kyc", f"""WITH {_SECTIONS}
    SELECT c.customer_id, 'kyc' AS check_type, k.kyc_state, k.documents_valid,
           CASE WHEN k.kyc_state <> 'verified' THEN 'REVIEW' ELSE 'CLEAR' END AS overall_status
    FROM customers c JOIN k USING (customer_id)""")
def _(spark, directory):
    customers, kyc, sanctions, pep, aml = _compliance_inputs(spark, directory)
    checked = comp.compliance_check(customers, kyc, sanctions, pep, aml, "kyc", AS_OF)
    return checked.select("customer_id", "check_type", F.col("kyc.status").alias("kyc_state"), "kyc.documents_valid",
                          "overall_status")


@query("F7_compliance_check_header", """
    SELECT customer_id, 'credit' AS check_type, '2001-08-01' AS timestamp, 'CLEAR' AS overall_status FROM customers""")
def _(spark, directory):
    customers, kyc, sanctions, pep, aml = _compliance_inputs(spark, directory)
    return comp.compliance_check(customers, kyc, sanctions, pep, aml, "credit", AS_OF)


@query("F8_kyc_status", """
    SELECT customer_id,
           CASE WHEN last_verification + INTERVAL 12 MONTH < DATE '2001-08-01' THEN 'expired' ELSE 'verified' END AS kyc_status,
           CASE WHEN len(documents_on_file) = 4 THEN 'enhanced' ELSE 'standard' END AS verification_level,
           strftime(last_verification, '%Y-%m-%d') AS last_verification_date,
           strftime(last_verification + INTERVAL 12 MONTH, '%Y-%m-%d') AS next_review_date,
           array_to_string(documents_on_file, '|') AS documents_on_file,
           array_to_string((['passport', 'utility_bill', 'bank_statement', 'source_of_wealth_declaration'])[len(documents_on_file) + 1:], '|')
             AS missing_documents,
           concat_ws('|', CASE WHEN last_verification + INTERVAL 12 MONTH < DATE '2001-08-01' THEN 'review_overdue' END,
                          CASE WHEN len(documents_on_file) < 4 THEN 'documents_missing' END) AS verification_flags,
           CASE WHEN risk_rating < 3 THEN 'low' WHEN risk_rating < 4 THEN 'medium' ELSE 'high' END AS risk_tier
    FROM kyc""")
def _(spark, directory):
    status = comp.kyc_status(d.kyc(spark, directory), AS_OF)
    return flat(status, ["documents_on_file", "missing_documents", "verification_flags"],
                ["last_verification_date", "next_review_date"])


@query("F9_review_schedule", "SELECT customer_id, '2002-08-01' AS next_review_date FROM customers")
def _(spark, directory):
    reviews = cust.review_schedule(d.customers(spark, directory).select("customer_id"), AS_OF)
    return flat(reviews, days=["next_review_date"])


@query("F10_sar_drafts", """
    SELECT 'SAR-20010801-' || customer_id AS report_id, 'DRAFT' AS status, customer_id,
           count(DISTINCT transaction_id) AS transaction_count, 'Total ' || count(*) AS narrative, 'SG' AS jurisdiction,
           'Authority' AS regulatory_body, '2001-08-16' AS filing_deadline, customer_id % 3 = 0 AS required_fields_complete,
           CASE customer_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'compliance_officer_review'
                ELSE 'authorized_signatory|compliance_officer_review' END AS missing_fields
    FROM transactions WHERE amount >= 50000 GROUP BY customer_id""")
def _(spark, directory):
    alerts = comp.transaction_alerts(d.transactions(spark, directory))
    third = F.col("customer_id") % 3
    narratives = alerts.groupBy("customer_id").agg(F.concat(F.lit("Total "), F.count("*").cast("string")).alias("narrative"))
    narratives = (narratives.withColumn("authorized_signatory", F.when(third < 2, "A. Signer"))
                  .withColumn("compliance_officer_review", F.when(third == 0, "done")))
    return flat(comp.sar_drafts(alerts, AS_OF, narratives, "SG", "Authority"), ["missing_fields"], ["filing_deadline"])


@query("F10_sar_transactions", """
    SELECT DISTINCT 'SAR-20010801-' || customer_id AS report_id, customer_id, transaction_id FROM transactions WHERE amount >= 50000""")
def _(spark, directory):
    return comp.sar_transactions(comp.transaction_alerts(d.transactions(spark, directory)), AS_OF)


# --- joins ---------------------------------------------------------------------

@query("J1_convert_currency", """
    SELECT product_id, nav, currency AS original_currency, 'USD' AS target_currency,
           round((nav / coalesce(f.rate, 1))::DECIMAL(38, 7), 2)::DOUBLE AS converted_amount,
           round((1.0::DOUBLE / coalesce(f.rate, 1))::DECIMAL(38, 7), 6)::DOUBLE AS rate_used
    FROM unit_trust u LEFT JOIN fx f USING (currency)""")
def _(spark, directory):
    products = d.unit_trust(spark, directory).select("product_id", "nav", "currency")
    return prod.convert_currency(products, "nav", "currency").drop("currency")


@query("J1_convert_currency_pairs", """
    SELECT transaction_id, lower(t.currency) AS original_currency, c.preferred_currency AS target_currency,
           round((amount / f.rate * g.rate)::DECIMAL(38, 7), 2)::DOUBLE AS converted_amount,
           round((g.rate / f.rate)::DECIMAL(38, 7), 6)::DOUBLE AS rate_used
    FROM transactions t JOIN customers c USING (customer_id) JOIN fx f ON f.currency = t.currency
    JOIN fx g ON g.currency = c.preferred_currency""")
def _(spark, directory):
    wanted = d.customers(spark, directory).select("customer_id", "preferred_currency")
    tx = d.transactions(spark, directory).join(wanted, "customer_id")
    converted = prod.convert_currency(tx.withColumn("currency", F.lower("currency")), "amount", "currency",
                                      "preferred_currency")
    return converted.select("transaction_id", "original_currency", "target_currency", "converted_amount", "rate_used")


@query("J2_regulatory_limits", """
    WITH hits AS (
      SELECT t.transaction_id, l.report_type, l.threshold, l.ord, t.amount FROM transactions t JOIN limits l
        ON l.jurisdiction = t.jurisdiction WHERE t.amount >= l.threshold
      UNION ALL SELECT transaction_id, 'CTR', 10000, 0, amount FROM transactions
        WHERE jurisdiction NOT IN (SELECT jurisdiction FROM limits) AND amount >= 10000)
    SELECT t.transaction_id, t.jurisdiction, t.amount, count(h.report_type) > 0 AS reporting_required,
           coalesce(string_agg(h.report_type, '|' ORDER BY h.ord), '') AS report_types,
           round(coalesce(sum(h.amount - h.threshold), 0)::DECIMAL(38, 7), 2)::DOUBLE AS exceeded_by,
           coalesce('File ' || arg_min(h.report_type, h.ord) || ' within regulatory timeframe', 'No reporting required')
             AS recommendation
    FROM transactions t LEFT JOIN hits h USING (transaction_id) GROUP BY ALL""")
def _(spark, directory):
    checked = comp.regulatory_limits(d.transactions(spark, directory))
    exceeded = F.aggregate("alerts", F.lit(0.0), lambda s, a: s + a["exceeded_by"])
    return checked.select("transaction_id", "jurisdiction", "amount", "reporting_required",
                          joined("alerts.report_type").alias("report_types"),
                          round_half_up(exceeded, 2).alias("exceeded_by"), "recommendation")


_SUITABLE = """
    SELECT c.customer_id, p.product_id, p.product_name, p.risk_rating, p.expense_ratio,
           row_number() OVER w AS rank, count(*) OVER (PARTITION BY c.customer_id) AS suitable_products
    FROM customers c JOIN unit_trust p ON p.risk_rating <= c.risk_rating
    WINDOW w AS (PARTITION BY c.customer_id ORDER BY p.expense_ratio, p.product_id)
    QUALIFY rank <= 5"""


@query("J3_suitable_products", _SUITABLE)
def _(spark, directory):
    return prod.suitable_products(d.customers(spark, directory), d.unit_trust(spark, directory))


@query("E2_recommendation_plan", f"""WITH {_SECTIONS}, top AS ({_SUITABLE})
    SELECT t.customer_id, c.name, c.risk_rating AS customer_risk, t.product_id, t.rank,
           CASE WHEN k.kyc_state <> 'verified' OR s.matches_found > 0 OR p.is_pep OR p.related_pep OR coalesce(a.aml_score >= 50, false)
                THEN 'REVIEW' ELSE 'CLEAR' END AS overall_status
    FROM top t JOIN customers c USING (customer_id) JOIN k USING (customer_id) JOIN s USING (customer_id)
    JOIN p USING (customer_id) LEFT JOIN a USING (customer_id)""")
def _(spark, directory):
    customers, kyc, sanctions, pep, aml = _compliance_inputs(spark, directory)
    checked = comp.compliance_check(customers, kyc, sanctions, pep, aml, "full", AS_OF)
    offers = recommend(customers, d.unit_trust(spark, directory), checked)
    return offers.select("customer_id", "name", "customer_risk", "product_id", "rank", "overall_status")


@query("J4_assess_suitability", """
    SELECT h.customer_id, h.product_id, CASE WHEN p.risk_rating <= c.risk_rating THEN 'SUITABLE' ELSE 'NOT_SUITABLE' END
             AS suitability_status, p.risk_rating <= c.risk_rating AS risk_match,
           concat_ws('|', CASE WHEN p.risk_rating > c.risk_rating THEN 'Product risk exceeds customer risk rating' END,
                     CASE WHEN p.currency <> c.preferred_currency THEN 'Product currency differs from preferred currency' END)
             AS warnings,
           concat_ws('|', 'Product risk disclosure', CASE WHEN p.currency <> c.preferred_currency THEN 'Currency risk disclosure' END)
             AS disclosures_required
    FROM holdings h JOIN customers c USING (customer_id) JOIN unit_trust p USING (product_id)""")
def _(spark, directory):
    pairs = d.holdings(spark, directory).select("customer_id", "product_id")
    assessed = prod.assess_suitability(pairs, d.customers(spark, directory), d.unit_trust(spark, directory))
    return flat(assessed, ["warnings", "disclosures_required"], drop=["factors_considered"])


_SCREENED = """
    c AS (SELECT customer_id, name, jurisdiction AS country, upper(replace(name, '#', ' ')) AS norm FROM customers),
    w AS (SELECT DISTINCT replace(listed_name, '  ', ' ') AS listed, list_name, country AS listed_country FROM watchlist),
    m AS (SELECT c.customer_id, c.name, c.country, w.*, round((1 - levenshtein(c.norm, w.listed)
                   / greatest(length(c.norm), length(w.listed), 1)::DOUBLE)::DECIMAL(38, 7), 4)::DOUBLE AS score
          FROM c JOIN w ON levenshtein(c.norm, w.listed) <= {distance})"""


def _screen_sql(distance: int) -> str:
    return f"""WITH {_SCREENED.format(distance=distance)}
    SELECT c.customer_id, c.name, count(m.listed) > 0 AS match_found, count(m.listed) AS matches_found,
           coalesce(max(m.score), 0) AS screening_score,
           CASE WHEN max(m.score) = 1 THEN 'BLOCK - Exact sanctions match'
                WHEN count(m.listed) > 0 THEN 'REVIEW - Potential sanctions matches found'
                ELSE 'CLEAR - No sanctions matches found' END AS recommendation
    FROM c LEFT JOIN m USING (customer_id) GROUP BY ALL"""


@query("J5_screen_names", _screen_sql(1))
def _(spark, directory):
    screened = scr.screen_names(d.customers(spark, directory), d.watchlist(spark, directory), max_distance=1)
    return screened.drop("lists_checked", "country")


@query("J5_screen_names_distance_2", _screen_sql(2))
def _(spark, directory):
    screened = scr.screen_names(d.customers(spark, directory), d.watchlist(spark, directory), max_distance=2)
    return screened.drop("lists_checked", "country")


@query("J5_screening_matches", f"""WITH {_SCREENED.format(distance=1)}
    SELECT customer_id, name, country, list_name, listed, listed_country, score, country = listed_country AS same_country FROM m""")
def _(spark, directory):
    return scr.screening_matches(d.customers(spark, directory), d.watchlist(spark, directory), max_distance=1)


@query("J6_check_pep", """
    WITH p AS (SELECT substr(pep_name, 10) AS no, min(category) AS pep_category FROM pep_list GROUP BY 1),
    r AS (SELECT customer_id, max(strength) AS strength FROM relations JOIN p ON p.no = substr(related_name, 10) GROUP BY 1)
    SELECT c.customer_id, c.name, p.no IS NOT NULL AS pep_status, p.pep_category, r.strength IS NOT NULL AS related_pep,
           coalesce(r.strength >= 2, false) AS close_associate,
           CASE WHEN p.no IS NOT NULL THEN 'PEP - Enhanced due diligence required'
                WHEN r.strength IS NOT NULL THEN 'Related to a PEP - Review required' ELSE 'No PEP indicators found' END
             AS recommendation
    FROM customers c LEFT JOIN p ON p.no = substr(c.name, 10) LEFT JOIN r USING (customer_id)""")
def _(spark, directory):
    checked = scr.check_pep(d.customers(spark, directory), d.pep_list(spark, directory), d.relations(spark, directory))
    return checked.drop("screening_sources")


_RATED = """
    rated AS (SELECT c.*, t.n, t.e, round((t.e / t.n::DOUBLE)::DECIMAL(38, 7), 4)::DOUBLE AS exception_rate,
        round(((1 - t.e / t.n::DOUBLE) * 100)::DECIMAL(38, 7), 2)::DOUBLE AS operating,
        round(((c.design_score + (1 - t.e / t.n::DOUBLE) * 100) / 2)::DECIMAL(38, 7), 2)::DOUBLE AS score
      FROM controls c LEFT JOIN (SELECT control_id, count(*) AS n, count(*) FILTER (exception) AS e FROM control_tests
                            WHERE period = 'Q4 2000' GROUP BY 1) t USING (control_id)),
    graded AS (SELECT *, CASE WHEN e IS NULL THEN 'Not Tested'
                 WHEN (design_score + (1 - e / n::DOUBLE) * 100) / 2 < 65 THEN 'Ineffective' WHEN (design_score + (1 - e / n::DOUBLE) * 100) / 2 < 75
                 THEN 'Partially Effective' ELSE 'Effective' END
                 AS rating FROM rated)"""


def _rated_controls(spark, directory):
    controls = d.controls(spark, directory)
    scores = rc.control_effectiveness(d.control_tests(spark, directory), controls, "Q4 2000")
    return controls.join(scores.select("control_id", "effectiveness_rating"), "control_id")


@query("J7_map_risks_to_controls", """
    SELECT r.risk_id, count(m.control_id) AS control_count, CASE WHEN count(m.control_id) > 0 THEN 'Adequate' ELSE 'None' END
             AS control_coverage
    FROM risks r LEFT JOIN risk_control m ON m.risk_id = r.risk_id GROUP BY r.risk_id""")
def _(spark, directory):
    return rc.map_risks_to_controls(d.risks(spark, directory), d.risk_control(spark, directory))


@query("J7_risk_controls", f"""WITH {_RATED}
    SELECT m.risk_id, m.control_id, g.control_type, g.rating AS effectiveness FROM risk_control m LEFT JOIN graded g USING (control_id)""")
def _(spark, directory):
    rated = _rated_controls(spark, directory).withColumnRenamed("effectiveness_rating", "effectiveness")
    return rc.risk_controls(d.risk_control(spark, directory), rated)


@query("J7_mapping_analysis", """
    SELECT (SELECT count(*) FROM risks) AS risks_analyzed,
           (SELECT count(*) FROM risk_control JOIN risks USING (risk_id)) AS total_controls_mapped,
           (SELECT count(DISTINCT risk_id) FROM risk_control JOIN risks USING (risk_id)) AS adequately_controlled""")
def _(spark, directory):
    return rc.mapping_analysis(d.risks(spark, directory), d.risk_control(spark, directory))


@query("J8_control_gaps", """
    SELECT risk_id, 'all' AS risk_category, category, level AS risk_exposure,
           CASE level WHEN 'High' THEN 'Critical' WHEN 'Medium' THEN 'High' ELSE 'Medium' END AS priority
    FROM risks WHERE risk_id NOT IN (SELECT risk_id FROM risk_control)""")
def _(spark, directory):
    return rc.control_gaps(d.risks(spark, directory), d.risk_control(spark, directory))


@query("J8_control_coverage", """
    SELECT 'PROMO' AS risk_category, count(*) AS total_risks, count(m.risk_id) AS risks_with_controls,
           round((count(m.risk_id) * 100.0::DOUBLE / count(*))::DECIMAL(38, 7), 4)::DOUBLE AS coverage_percentage
    FROM risks r LEFT JOIN (SELECT DISTINCT risk_id FROM risk_control) m ON m.risk_id = r.risk_id WHERE category = 'PROMO'""")
def _(spark, directory):
    return rc.control_coverage(d.risks(spark, directory), d.risk_control(spark, directory), "PROMO")


@query("J9_compare_products", """
    WITH s AS (SELECT product_id, avg(price) FILTER (month > DATE '2000-08-01') AS now_,
                      avg(price) FILTER (month <= DATE '2000-08-01' AND month > DATE '1999-08-01') AS then_,
                      stddev_samp(price) / avg(price) AS spread FROM product_prices GROUP BY 1),
    m AS (SELECT u.product_id, u.risk_rating::DOUBLE AS r, u.expense_ratio AS e,
                 round(((now_ / then_ - 1) * 100)::DECIMAL(38, 7), 4)::DOUBLE AS y, round(spread::DECIMAL(38, 7), 4)::DOUBLE AS v
          FROM unit_trust u LEFT JOIN s USING (product_id)
          WHERE u.product_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'))
    SELECT product_id, 'risk_rating' AS metric, r AS value FROM m UNION ALL SELECT product_id, 'expense_ratio', e FROM m
    UNION ALL SELECT product_id, '1y_return', y FROM m UNION ALL SELECT product_id, 'volatility', v FROM m""")
def _(spark, directory):
    metrics = prod.product_metrics(d.unit_trust(spark, directory), d.product_prices(spark, directory), AS_OF)
    returned = load_table(spark, directory, "lineitem").where(F.col("l_returnflag") == "R").select("l_partkey")
    return prod.compare_products(metrics, returned)


@query("J9_comparison_matrix", """
    WITH u AS (SELECT risk_rating::DOUBLE AS r, expense_ratio AS e, product_id FROM unit_trust)
    SELECT m AS metric, max(CASE WHEN product_id = 1 THEN v END) AS "1", max(CASE WHEN product_id = 2 THEN v END) AS "2"
    FROM (SELECT product_id, 'risk_rating' AS m, r AS v FROM u UNION ALL SELECT product_id, 'expense_ratio', e FROM u) GROUP BY 1""")
def _(spark, directory):
    metrics = prod.product_metrics(d.unit_trust(spark, directory), d.product_prices(spark, directory), AS_OF)
    return prod.comparison_matrix(metrics, [1, 2]).where(F.col("metric").isin("risk_rating", "expense_ratio"))


# --- aggregates and windows ------------------------------------------------------

def _risk_score_sql(with_activity: bool) -> str:
    activity = "transaction_behavior_risk" if with_activity else "0"
    return f"""
    WITH s AS (SELECT *, geographic_risk + product_risk + channel_risk + customer_type_risk + tenure_risk + {activity} AS total,
                      round(total::DECIMAL(38, 7), 2)::DOUBLE AS risk_score FROM risk_factors)
    SELECT customer_id, risk_score,
           CASE WHEN total < 30 THEN 'LOW' WHEN total < 50 THEN 'MEDIUM' WHEN total < 70 THEN 'HIGH'
                ELSE 'CRITICAL' END AS risk_level,
           {activity}::DOUBLE AS transaction_behavior_risk,
           concat_ws('|', CASE WHEN geographic_risk >= 10 THEN 'geographic_risk' END,
             CASE WHEN product_risk >= 10 THEN 'product_risk' END, CASE WHEN channel_risk >= 10 THEN 'channel_risk' END,
             CASE WHEN customer_type_risk >= 10 THEN 'customer_type_risk' END,
             CASE WHEN tenure_risk >= 10 THEN 'tenure_risk' END) AS risk_factors,
           '2002-08-01' AS next_review_date FROM s"""


def _risk_score(spark, directory, with_activity):
    scored = cust.customer_risk_score(d.risk_factors(spark, directory), AS_OF, with_activity)
    return scored.select("customer_id", "risk_score", "risk_level",
                         F.col("risk_breakdown")[cust.TRANSACTION_FACTOR].alias("transaction_behavior_risk"),
                         joined("risk_factors").alias("risk_factors"), day("next_review_date").alias("next_review_date"))


@query("A1_customer_risk_score", _risk_score_sql(True))
def _(spark, directory):
    return _risk_score(spark, directory, True)


@query("A1_customer_risk_score_base", _risk_score_sql(False))
def _(spark, directory):
    return _risk_score(spark, directory, False)


_PROFILE = """
    d AS (SELECT customer_id, ts::DATE AS day, count(*) AS n, sum(amount) AS total, sum(amount * amount) AS sq,
                 max(amount) AS top, count(*) FILTER (amount >= 100000) AS large_n FROM transactions GROUP BY ALL),
    w AS (SELECT *, sum(n) OVER b AS pn, sum(total) OVER b AS pt, sum(sq) OVER b AS ps,
                 sum(large_n) OVER (PARTITION BY customer_id ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)
                   AS large_30d
          FROM d WINDOW b AS (PARTITION BY customer_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    profile AS (SELECT customer_id,
        round((sum(total) / count(DISTINCT date_trunc('month', day)))::DECIMAL(38, 7), 2)::DOUBLE AS avg_monthly_volume,
        coalesce(sum(large_n) FILTER (day > DATE '2001-07-02' AND day <= DATE '2001-08-01'), 0)::BIGINT AS large_transactions_30d,
        max(large_30d)::BIGINT AS peak_large_30d,
        bool_or(pn >= 2 AND top > pt / pn + 3 * sqrt(greatest(0, CASE WHEN pn > 1 THEN (ps - pt * (pt / pn)) / (pn - 1) ELSE 0 END)))
          AS unusual
      FROM w GROUP BY 1)"""


@query("W1_transaction_profile", f"""WITH {_PROFILE}
    SELECT customer_id, avg_monthly_volume, large_transactions_30d, peak_large_30d, coalesce(unusual, false) AS unusual_patterns
    FROM profile""")
def _(spark, directory):
    return cust.transaction_profile(d.transactions(spark, directory), AS_OF)


@query("A2_customer_risk_assessment", f"""WITH {_PROFILE}, k AS (SELECT customer_id, last_verification + INTERVAL 12 MONTH < DATE '2001-08-01' AS late FROM kyc),
    s AS (SELECT *, round((geographic_risk + product_risk + channel_risk + customer_type_risk + tenure_risk
                           + transaction_behavior_risk)::DECIMAL(38, 7), 2)::DOUBLE AS risk_score FROM risk_factors)
    SELECT s.customer_id, s.risk_score,
           CASE WHEN risk_score < 30 THEN 'LOW' WHEN risk_score < 50 THEN 'MEDIUM' WHEN risk_score < 70 THEN 'HIGH'
                ELSE 'CRITICAL' END AS risk_level,
           f.avg_monthly_volume, f.large_transactions_30d, CASE WHEN k.late THEN 'REVIEW' ELSE 'CLEAR' END AS overall_status
    FROM s LEFT JOIN profile f USING (customer_id) JOIN k USING (customer_id)""")
def _(spark, directory):
    checked = comp.compliance_check(d.customers(spark, directory), comp.kyc_status(d.kyc(spark, directory), AS_OF),
                                    check_type="kyc", as_of=AS_OF)
    assessed = cust.customer_risk_assessment(d.risk_factors(spark, directory), d.transactions(spark, directory),
                                             checked, AS_OF)
    return assessed.select("customer_id", "risk_score", "risk_level", "transaction_analysis.avg_monthly_volume",
                           "transaction_analysis.large_transactions_30d", "compliance_status.overall_status")


@query("A3_aggregate_table", """
    SELECT currency, count(*) AS products, round(avg(nav)::DECIMAL(38, 7), 4)::DOUBLE AS avg_nav, max(risk_rating) AS top_risk
    FROM unit_trust GROUP BY currency""")
def _(spark, directory):
    return look.aggregate_table(d.unit_trust(spark, directory), "currency", {
        "products": "count(*)", "avg_nav": "CAST(round(CAST(avg(nav) AS DECIMAL(38, 7)), 4) AS DOUBLE)",
        "top_risk": "max(risk_rating)"})


@query("A3_aggregate_table_filtered", """
    SELECT asset_class, count(*) AS products, min(nav) AS lowest FROM unit_trust WHERE asset_class = 'PROMO' GROUP BY 1""")
def _(spark, directory):
    return look.aggregate_table(d.unit_trust(spark, directory), "asset_class",
                                {"products": "count(*)", "lowest": "min(nav)"}, "PROMO")


_ALLOCATION = """
    pc AS (SELECT customer_id, asset_class, sum(value) AS v FROM product_holdings GROUP BY ALL),
    alloc AS (SELECT customer_id, asset_class, v, sum(v) OVER (PARTITION BY customer_id) AS t,
                     v / sum(v) OVER (PARTITION BY customer_id) * 100 AS allocation FROM pc)"""


@query("A4_portfolio_allocation", f"""WITH {_ALLOCATION}
    SELECT customer_id, asset_class, round(v::DECIMAL(38, 7), 2)::DOUBLE AS class_value,
           round(t::DECIMAL(38, 7), 2)::DOUBLE AS total_value, round(allocation::DECIMAL(38, 7), 4)::DOUBLE AS allocation FROM alloc""")
def _(spark, directory):
    shares = port.portfolio_allocation(d.product_holdings(spark, directory))
    return shares.withColumn("allocation", round_half_up(F.col("allocation"), 4))


@query("A5_portfolio_risk", """
    WITH pc AS (SELECT customer_id, asset_class, sum(value) AS v, sum(value * risk_rating) AS w FROM product_holdings GROUP BY ALL),
    q AS (SELECT customer_id, date_trunc('quarter', ts) AS period, sum(amount) AS volume FROM transactions GROUP BY ALL),
    r AS (SELECT customer_id, volume / lag(volume) OVER (PARTITION BY customer_id ORDER BY period) - 1 AS ret FROM q),
    s AS (SELECT customer_id, avg(ret) AS m, stddev_samp(ret) AS dv FROM r WHERE ret IS NOT NULL GROUP BY 1),
    h AS (SELECT customer_id, sum(v) AS v, sum(w) AS w, sum(v * v) AS sq FROM pc GROUP BY 1)
    SELECT customer_id, round(v::DECIMAL(38, 7), 2)::DOUBLE AS total_value,
           round((w / v)::DECIMAL(38, 7), 4)::DOUBLE AS portfolio_risk_score,
           CASE WHEN dv IS NULL THEN NULL WHEN dv < 0.5 THEN 'Low' WHEN dv < 1.5 THEN 'Medium' ELSE 'High' END AS volatility,
           round((CASE WHEN dv = 0 THEN NULL ELSE m / dv END)::DECIMAL(38, 7), 4)::DOUBLE AS sharpe_ratio,
           round((100 * (1 - sq / (v * v)))::DECIMAL(38, 7), 4)::DOUBLE AS diversification_score
    FROM h LEFT JOIN s USING (customer_id)""")
def _(spark, directory):
    returns = port.period_returns(d.transactions(spark, directory))
    return port.portfolio_risk(d.product_holdings(spark, directory), returns)


@query("A6_rebalance_advice", f"""WITH {_ALLOCATION},
    g AS (SELECT p_type AS asset_class, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM part) AS target FROM part GROUP BY 1),
    f AS (SELECT c.customer_id, g.asset_class, g.target, coalesce(a.allocation, 0) - g.target AS drift
          FROM (SELECT DISTINCT customer_id FROM pc) c CROSS JOIN g
          LEFT JOIN alloc a ON a.customer_id = c.customer_id AND a.asset_class = g.asset_class)
    SELECT customer_id, asset_class, round(target::DECIMAL(38, 7), 4)::DOUBLE AS target,
           round(drift::DECIMAL(38, 7), 4)::DOUBLE AS drift,
           CASE WHEN drift > 0 THEN 'Consider reducing ' || asset_class || ' exposure by ' ELSE 'Consider adding ' || asset_class || ' exposure of ' END
             || round(abs(drift)::DECIMAL(38, 7), 1)::DECIMAL(38, 1)::VARCHAR || '%' AS recommendation
    FROM f WHERE abs(drift) > 5""")
def _(spark, directory):
    parts = load_table(spark, directory, "part")
    total = parts.agg(F.count("*").alias("n")).scalar()
    targets = (parts.groupBy(F.col("p_type").alias("asset_class")).agg(F.count("*").alias("n"))
               .select("asset_class", (F.col("n") * 100.0 / total).alias("target")))
    advice = port.rebalance_advice(port.portfolio_allocation(d.product_holdings(spark, directory)), targets)
    return advice.withColumn("target", round_half_up(F.col("target"), 4))


@query("A7_control_effectiveness", f"""WITH {_RATED}
    SELECT control_id, 'Q4 2000' AS assessment_period, coalesce(n, 0) AS samples_tested, coalesce(e, 0) AS exceptions_found, exception_rate,
           design_score AS design_effectiveness, operating AS operating_effectiveness, score AS effectiveness_score,
           rating AS effectiveness_rating FROM graded""")
def _(spark, directory):
    return rc.control_effectiveness(d.control_tests(spark, directory), d.controls(spark, directory), "Q4 2000")


def _rcsa_sql(with_actions: bool) -> str:
    actions = ("coalesce(a.o, 0) AS open_actions, coalesce(a.l, 0) AS overdue_actions, coalesce(a.c, 0) AS completed_this_period"
               if with_actions else
               "NULL::BIGINT AS open_actions, NULL::BIGINT AS overdue_actions, NULL::BIGINT AS completed_this_period")
    return f"""WITH {_RATED},
    r AS (SELECT business_unit, count(*) AS n, count(*) FILTER (level = 'High') AS h, count(*) FILTER (level = 'Medium') AS m,
                 count(*) FILTER (level = 'Low') AS l FROM risks GROUP BY 1),
    g AS (SELECT business_unit, count(*) AS n, count(*) FILTER (rating = 'Effective') AS e,
                 count(*) FILTER (rating = 'Partially Effective') AS p, count(*) FILTER (rating = 'Ineffective') AS i
          FROM graded GROUP BY 1),
    a AS (SELECT business_unit, count(*) FILTER (status = 'open') AS o, count(*) FILTER (status = 'overdue') AS l,
                 count(*) FILTER (status = 'completed') AS c FROM remediation_actions GROUP BY 1)
    SELECT n_nationkey AS business_unit, '2024' AS period, coalesce(r.n, 0) AS total_risks, coalesce(r.h, 0) AS high_risks,
           coalesce(r.m, 0) AS medium_risks, coalesce(r.l, 0) AS low_risks, coalesce(g.n, 0) AS total_controls,
           coalesce(g.e, 0) AS effective_controls, coalesce(g.p, 0) AS partially_effective, coalesce(g.i, 0) AS ineffective,
           {actions}
    FROM nation u LEFT JOIN r ON r.business_unit = n_nationkey LEFT JOIN g ON g.business_unit = n_nationkey
    LEFT JOIN a ON a.business_unit = n_nationkey"""


def _rcsa(spark, directory, with_actions):
    return rc.rcsa_summary(d.risks(spark, directory), _rated_controls(spark, directory),
                           d.remediation_actions(spark, directory), include_remediation=with_actions)


@query("A8_rcsa_summary", _rcsa_sql(True))
def _(spark, directory):
    return _rcsa(spark, directory, True)


@query("A8_rcsa_summary_no_remediation", _rcsa_sql(False))
def _(spark, directory):
    return _rcsa(spark, directory, False)


_KRI = """
    SELECT business_unit, kri, strftime(period_start, '%Y-%m-%d') AS period_start, v AS value,
           CASE WHEN v >= 0.5 THEN 'Red' WHEN v >= 0.33 THEN 'Amber' ELSE 'Green' END AS status,
           CASE WHEN v < p THEN 'Improving' WHEN v > p THEN 'Deteriorating' ELSE 'Stable' END AS trend
    FROM (SELECT *, lag(v) OVER (PARTITION BY business_unit, kri ORDER BY period_start) AS p
          FROM (SELECT *, round(value::DECIMAL(38, 7), 6)::DOUBLE AS v FROM kri_measures))"""


@query("A9_kri_status", _KRI)
def _(spark, directory):
    status = rc.kri_status(d.kri_measures(spark, directory), amber=0.33, red=0.5)
    return flat(status, days=["period_start"])


@query("W3_period_trend", f"SELECT kri, trend, status, count(*) AS periods FROM ({_KRI}) GROUP BY ALL")
def _(spark, directory):
    status = rc.kri_status(d.kri_measures(spark, directory), amber=0.33, red=0.5)
    return status.groupBy("kri", "trend", "status").agg(F.count("*").alias("periods"))


@query("W2_top_n_per_group", """
    SELECT o_custkey AS customer_id, o_orderkey AS transaction_id, o_totalprice AS amount, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
    WHERE rank <= 3""")
def _(spark, directory):
    tx = d.transactions(spark, directory).select("customer_id", "transaction_id", "amount")
    return top_n_per(tx, ["customer_id"], [F.desc("amount"), F.asc("transaction_id")], 3)


# --- scores ------------------------------------------------------------------------

@query("S7_risk_level", """
    SELECT p_partkey AS product_id, CASE WHEN p_size * 2 < 30 THEN 'LOW' WHEN p_size * 2 < 50 THEN 'MEDIUM'
           WHEN p_size * 2 < 70 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level FROM part""")
def _(spark, directory):
    return load_table(spark, directory, "part").select(
        F.col("p_partkey").alias("product_id"), risk_level(F.col("p_size") * 2).alias("risk_level"))


@query("S8_residual_risk", """
    SELECT risk_id, inherent_risk_score, control_effectiveness, round(r::DECIMAL(38, 7), 2)::DOUBLE AS residual_risk_score,
           CASE WHEN r < 1 THEN 'Low' WHEN r < 2.5 THEN 'Medium' WHEN r < 4 THEN 'High' ELSE 'Critical' END AS residual_risk_level,
           CASE WHEN inherent_risk_score = 0 THEN NULL
                ELSE round(((1 - r / inherent_risk_score) * 100)::DECIMAL(38, 7), 1)::DOUBLE END AS risk_reduction,
           r < 2.5 AS within_appetite,
           CASE WHEN r >= 2.5 THEN 'Additional controls recommended' ELSE 'Risk within appetite' END AS recommendation
    FROM (SELECT *, inherent_risk_score * (1 - control_effectiveness / 100) AS r FROM residual_input)""")
def _(spark, directory):
    return residual_risk(d.residual_input(spark, directory))
