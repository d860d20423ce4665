"""SQL definitions of the domain views (FIXTURES.md), written apart from the Spark ones."""

from __future__ import annotations

import re

AS_OF = "DATE '2001-08-01'"


def pick(values: str, number: str) -> str:
    n = values.count(",") + 1
    quoted = ", ".join(f"'{v.strip()}'" for v in values.split(","))
    return f"([{quoted}])[(({number}) % {n} + 1)::INT]"


CCY = "USD, EUR, GBP, SGD, AUD, JPY"
JUR = "SG, US, UK, EU, HK"
UNI_WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

VIEWS = {
    "customers": f"""
        SELECT c_custkey AS customer_id, c_name AS name, (c_custkey % 5 + 1)::INT AS risk_rating,
               c_acctbal AS account_balance, {pick(CCY, 'c_nationkey')} AS preferred_currency,
               {pick(JUR, 'c_nationkey')} AS jurisdiction
        FROM customer""",
    "customer_profile": """
        SELECT c.*, s.customer_since FROM customers c LEFT JOIN
          (SELECT o_custkey, min(o_orderdate)::DATE AS customer_since FROM orders GROUP BY 1) s ON s.o_custkey = c.customer_id""",
    "unit_trust": f"""
        SELECT p_partkey AS product_id, p_name AS product_name, (p_size % 5 + 1)::INT AS risk_rating,
               CASE WHEN p_partkey % 97 = 0 THEN 'XXX' ELSE {pick(CCY, 'p_partkey')} END AS currency,
               p_retailprice AS nav, 0.5::DOUBLE + (p_partkey % 100) / 100.0::DOUBLE AS expense_ratio, p_type AS asset_class
        FROM part""",
    "transactions": f"""
        SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, o_totalprice AS amount, o_orderdate AS ts,
               {pick('credit, debit, transfer, trade', 'o_orderkey')} AS type, {pick(CCY, 'o_custkey')} AS currency,
               {pick(JUR, 'o_custkey')} AS jurisdiction
        FROM orders""",
    "holdings": """
        SELECT o_custkey AS customer_id, l_partkey AS product_id, sum(l_extendedprice * (1 - l_discount)) AS value
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
    "product_holdings": """
        SELECT h.customer_id, h.product_id, h.value, u.asset_class, u.risk_rating
        FROM holdings h JOIN unit_trust u USING (product_id)""",
    "risk_factors": """
        SELECT c_custkey AS customer_id, (c_nationkey % 21)::DOUBLE AS geographic_risk,
               round((coalesce(b.r, 0) * 4)::DECIMAL(38, 7), 2)::DOUBLE AS product_risk,
               (c_custkey % 13)::DOUBLE AS channel_risk, (c_custkey % 17)::DOUBLE AS customer_type_risk,
               (c_custkey % 11)::DOUBLE AS tenure_risk,
               round((coalesce(a.s, 0) * 20)::DECIMAL(38, 7), 2)::DOUBLE AS transaction_behavior_risk
        FROM customer
        LEFT JOIN (SELECT customer_id, avg(risk_rating) AS r FROM product_holdings GROUP BY 1) b ON b.customer_id = c_custkey
        LEFT JOIN (SELECT o_custkey, avg(CASE WHEN o_totalprice >= 100000 THEN 1 ELSE 0 END) AS s
                   FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey""",
    "kyc": f"""
        SELECT c_custkey AS customer_id, ({AS_OF} - (c_custkey % 500)::INT) AS last_verification,
               (['passport', 'utility_bill', 'bank_statement', 'source_of_wealth_declaration'])[1:(c_custkey % 3 + 2)]
                 AS documents_on_file,
               (c_custkey % 5 + 1)::INT AS risk_rating
        FROM customer""",
    "watchlist": f"""
        SELECT s_suppkey AS entry_id, 'CUSTOMER  ' || substr(s_name, 10, 9) AS listed_name,
               {pick('OFAC, UN, EU, UK_HMT, SG_MAS', 's_suppkey')} AS list_name, {pick(JUR, 's_nationkey')} AS country
        FROM supplier""",
    "pep_list": f"""
        SELECT s_suppkey AS pep_id, 'customer-' || substr(s_name, 10, 9) AS pep_name,
               {pick('government, military, judiciary', 's_nationkey')} AS category
        FROM supplier WHERE s_acctbal >= 9000""",
    "relations": """
        SELECT o_custkey AS customer_id, 'Customer#' || substr(s_name, 10, 9) AS related_name, count(*) AS strength
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""",
    "risks": """
        SELECT p_partkey AS risk_id, p_type AS category,
               CASE WHEN p_size <= 20 THEN 'Low' WHEN p_size <= 40 THEN 'Medium' ELSE 'High' END AS level,
               (p_partkey % 25)::INT AS business_unit
        FROM part""",
    "controls": f"""
        SELECT s_suppkey AS control_id, s_nationkey AS business_unit, (s_suppkey % 41 + 60)::DOUBLE AS design_score,
               {pick('Preventive, Detective', 's_suppkey')} AS control_type
        FROM supplier""",
    "risk_control": """
        SELECT DISTINCT l_partkey AS risk_id, l_suppkey AS control_id FROM lineitem WHERE l_quantity >= 48""",
    "control_tests": """
        SELECT l_suppkey AS control_id, l_returnflag = 'R' AS exception, l_linestatus = 'O' AS pending,
               'Q' || quarter(l_shipdate) || ' ' || year(l_shipdate) AS period,
               date_trunc('quarter', l_shipdate)::DATE AS period_start
        FROM lineitem""",
    "kri_wide": """
        SELECT business_unit, period_start, count(*) FILTER (exception) / count(*)::DOUBLE AS exceptions,
               count(*) FILTER (pending) / count(*)::DOUBLE AS pending
        FROM control_tests JOIN controls USING (control_id) GROUP BY ALL""",
    "kri_measures": """
        SELECT business_unit, period_start, 'Control Exceptions' AS kri, exceptions AS value FROM kri_wide
        UNION ALL SELECT business_unit, period_start, 'Pending Items', pending FROM kri_wide""",
    "remediation_actions": """
        SELECT o_orderkey AS action_id, (o_custkey % 25)::INT AS business_unit,
               CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'completed' ELSE 'overdue' END AS status
        FROM orders""",
    "residual_input": """
        SELECT p_partkey AS risk_id, (p_size % 6)::DOUBLE AS inherent_risk_score, (p_partkey % 101)::DOUBLE AS control_effectiveness
        FROM part""",
    "edges": """
        SELECT 'C' || o_custkey AS src, 'PLACED' AS rel, 'O' || o_orderkey AS dst FROM orders
        UNION ALL SELECT 'O' || l_orderkey, 'CONTAINS', 'P' || l_partkey FROM lineitem
        UNION ALL SELECT 'P' || l_partkey, 'SUPPLIED_BY', 'S' || l_suppkey FROM lineitem
        UNION ALL SELECT 'C' || c_custkey, 'IN', 'N' || c_nationkey FROM customer
        UNION ALL SELECT 'S' || s_suppkey, 'IN', 'N' || s_nationkey FROM supplier
        UNION ALL SELECT 'N' || n_nationkey, 'IN', 'R' || n_regionkey FROM nation""",
    "nodes": """
        SELECT 'C' || c_custkey AS id, 'customer' AS type, c_name AS name FROM customer
        UNION ALL SELECT 'O' || o_orderkey, 'order', o_orderkey::VARCHAR FROM orders
        UNION ALL SELECT 'P' || p_partkey, 'product', p_name FROM part
        UNION ALL SELECT 'S' || s_suppkey, 'supplier', s_name FROM supplier
        UNION ALL SELECT 'N' || n_nationkey, 'nation', n_name FROM nation
        UNION ALL SELECT 'R' || r_regionkey, 'region', r_name FROM region""",
    "audit_log": """
        SELECT event_id, ts AS timestamp, event_type AS action, user_id::VARCHAR AS user_id, user_id::VARCHAR AS customer_id,
               props AS details, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
               value AS execution_time_ms
        FROM events""",
    "finance_text": """
        SELECT o_orderkey AS doc_id,
               (['Refund of the fund', 'KYC file checked', 'Transaction booked', 'Risk reviewed', 'Note'])[(o_orderkey % 5 + 1)::INT]
               || ' for client ' || o_custkey || '.' || chr(10) || 'Amount $' || format('{:,.2f}', o_totalprice)
               || ' on ' || strftime(o_orderdate, '%m/%d/%Y') || ' at ' || (o_orderkey % 40) || '.' || (o_orderkey % 10)
               || '%.' || chr(10) || 'Write to client.' || o_custkey || '@bank' || (o_orderkey % 7) || '.com or call '
               || lpad((o_orderkey % 800 + 200)::VARCHAR, 3, '0') || '-' || lpad((o_custkey % 900)::VARCHAR, 3, '0') || '-'
               || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || '.' || chr(10) || 'SSN '
               || lpad((o_custkey % 1000)::VARCHAR, 3, '0') || '-' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || '-'
               || lpad((o_orderkey % 9999)::VARCHAR, 4, '0') || ', account ' || lpad(o_custkey::VARCHAR, 11, '0')
               || ', card ' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || ' 5500 '
               || lpad((o_custkey % 10000)::VARCHAR, 4, '0') || ' 0042.' AS text,
               o_orderstatus AS source
        FROM orders""",
    "doc_words": f"""
        SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{UNI_WS}'),
                                                 lambda w: w <> '')) AS words
        FROM documents""",
    "pair_words": """
        SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, a.words AS words_a, b.words AS words_b
        FROM doc_words a JOIN doc_words b ON b.doc_id = a.doc_id + 1""",
    "product_prices": """
        SELECT l_partkey AS product_id, date_trunc('month', l_shipdate)::DATE AS month,
               sum(l_extendedprice) / sum(l_quantity) AS price
        FROM lineitem GROUP BY ALL""",
    "label_centroids": """
        SELECT label AS query_id, list(m ORDER BY pos) AS embedding FROM (
          SELECT label, pos, avg(x) AS m FROM (
            SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
          GROUP BY ALL) GROUP BY label""",
    "fx": """
        SELECT * FROM (VALUES ('USD', 1.0::DOUBLE), ('EUR', 0.92), ('GBP', 0.79), ('SGD', 1.34), ('AUD', 1.53), ('JPY', 149.5))
          t(currency, rate)""",
    "limits": """
        SELECT * FROM (VALUES ('SG', 'CTR', 20000.0::DOUBLE, 0), ('SG', 'STR', 0.0, 1), ('US', 'CTR', 10000.0, 0),
          ('US', 'SAR', 5000.0, 1), ('UK', 'SAR', 0.0, 0), ('EU', 'CTR', 10000.0, 0)) t(jurisdiction, report_type, threshold, ord)""",
}


def with_views(sql: str) -> str:
    """Prefix the query with the views it names, directly or through others."""
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in wanted:
                    wanted.append(name)

    visit(sql)
    if not wanted:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in wanted)
    text = sql.strip()
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{text[len('WITH RECURSIVE'):]}"
    if text.upper().startswith("WITH "):
        return f"WITH {ctes},\n{text[len('WITH '):]}"
    return f"WITH {ctes}\n{text}"
