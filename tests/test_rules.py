"""Values worked out by hand from the computed rules, and edge rows."""

import datetime
import json
import math
import re

import pytest
from pyspark.sql import functions as F

from clientlens.common import round_half_up
from clientlens.functions import keys, scores, text, vectors
from clientlens.operators import audit, compliance, conversations, customers, lookup, portfolio, products, risk_control, search
from clientlens.sources import dimensions
from clientlens.streaming.audit import masked_entries

FACTORS = ("customer_id long, geographic_risk double, product_risk double, channel_risk double, "
           "customer_type_risk double, tenure_risk double, transaction_behavior_risk double")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def values(df, column):
    return [r[column] for r in df.collect()]


def test_customer_risk_score(spark):
    factors = spark.createDataFrame([(1, 15.0, 10.0, 8.0, 12.0, 5.0, 8.0)], FACTORS)
    full = one(customers.customer_risk_score(factors, "2024-01-01"))
    assert (full.risk_score, full.risk_level) == (58.0, "HIGH")
    assert full.risk_factors == ["geographic_risk", "product_risk", "customer_type_risk"]
    assert full.risk_breakdown["transaction_behavior_risk"] == 8.0
    assert full.next_review_date == datetime.date(2024, 12, 31)
    base = one(customers.customer_risk_score(factors, "2024-01-01", include_transactions=False))
    assert (base.risk_score, base.risk_level) == (50.0, "HIGH")
    assert base.risk_breakdown["transaction_behavior_risk"] == 0.0


def test_risk_level_bounds(spark):
    df = spark.createDataFrame([(29.99,), (30.0,), (49.99,), (50.0,), (69.99,), (70.0,), (None,)], "s double")
    assert values(df.select(scores.risk_level(F.col("s")).alias("l")), "l") == [
        "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", None]


@pytest.mark.parametrize("jurisdiction, amount, types, exceeded, advice", [
    ("SG", 20000.0, ["CTR", "STR"], [0.0, 20000.0], "File CTR within regulatory timeframe"),
    ("SG", 19999.0, ["STR"], [19999.0], "File STR within regulatory timeframe"),
    ("US", 9999.0, ["SAR"], [4999.0], "File SAR within regulatory timeframe"),
    ("US", 10000.0, ["CTR", "SAR"], [0.0, 5000.0], "File CTR within regulatory timeframe"),
    ("UK", 0.0, ["SAR"], [0.0], "File SAR within regulatory timeframe"),
    ("EU", 9999.0, [], [], "No reporting required"),
    ("HK", 9999.0, [], [], "No reporting required"),
    ("HK", 10000.0, ["CTR"], [0.0], "File CTR within regulatory timeframe"),
    (None, 1.0, ["STR"], [1.0], "File STR within regulatory timeframe"),
])
def test_regulatory_limits(spark, jurisdiction, amount, types, exceeded, advice):
    tx = spark.createDataFrame([(1, amount, jurisdiction)], "transaction_id long, amount double, jurisdiction string")
    row = one(compliance.regulatory_limits(tx))
    assert [a.report_type for a in row.alerts] == types
    assert [a.exceeded_by for a in row.alerts] == exceeded
    assert row.reporting_required == bool(types)
    assert row.recommendation == advice


def test_regulatory_limits_with_own_thresholds(spark):
    table = spark.createDataFrame([("JP", "CTR", 5.0, 0)], "jurisdiction string, report_type string, threshold double, ord int")
    tx = spark.createDataFrame([(1, 7.0, "JP")], "transaction_id long, amount double, jurisdiction string")
    assert one(compliance.regulatory_limits(tx, thresholds=table)).alerts[0].exceeded_by == 2.0


def test_thresholds_do_not_shuffle_transactions(spark):
    tx = spark.range(100).select(F.col("id").alias("transaction_id"), F.lit(1.0).alias("amount"), F.col("id").cast("string").alias("jurisdiction"))
    plan = compliance.regulatory_limits(tx)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_residual_risk(spark):
    df = spark.createDataFrame([(4.0, 50.0), (0.0, 50.0), (5.0, 20.0), (5.0, 50.0), (1.0, 50.0)],
                               "inherent_risk_score double, control_effectiveness double")
    a, zero, critical, edge, low = scores.residual_risk(df).collect()
    assert (a.residual_risk_score, a.residual_risk_level, a.risk_reduction, a.within_appetite) == (2.0, "Medium", 50.0, True)
    assert zero.risk_reduction is None and zero.residual_risk_level == "Low"
    assert critical.residual_risk_level == "Critical"
    assert (edge.residual_risk_level, edge.within_appetite) == ("High", False)
    assert edge.recommendation == "Additional controls recommended"
    assert low.residual_risk_level == "Low"


def test_convert_currency(spark):
    df = spark.createDataFrame([(100.0, "GBP"), (100.0, "gbp"), (100.0, "XXX"), (100.0, None)], "amount double, code string")
    rows = products.convert_currency(df, "amount", "code").collect()
    by_code = {r.original_currency: r for r in rows}
    assert by_code["GBP"].converted_amount == 126.58
    assert by_code["gbp"].converted_amount == 126.58 and by_code["gbp"].target_currency == "USD"
    assert by_code["GBP"].rate_used == 1.265823
    assert by_code["XXX"].converted_amount == 100.0 and by_code["XXX"].rate_used == 1.0
    assert by_code[None].converted_amount == 100.0
    own = dimensions.fx_rates(spark).unionByName(spark.createDataFrame([("XXX", 4.0)], "currency string, rate double"))
    joined = {r.original_currency: r for r in products.convert_currency(df, "amount", "code", rates=own).collect()}
    assert joined["XXX"].converted_amount == 25.0 and joined["gbp"].converted_amount == 126.58 and len(joined) == 4
    jpy = one(products.convert_currency(df.limit(1), "amount", F.lit("USD"), F.lit("JPY")))
    assert jpy.converted_amount == 14950.0


def python_mask(value):
    for pattern in text.MASK_PATTERNS.values():
        value = re.sub(pattern, lambda m: "*" * len(m[0]) if len(m[0]) <= 4 else m[0][:2] + "*" * (len(m[0]) - 4) + m[0][-2:], value)
    return value


MASK_SAMPLES = [
    "Email: john@bank.com", "call 555-123-4567 now", "5551234567", "ssn 123-45-6789.", "card 4111 1111 1111 1111 and 4111-1111-1111-1111",
    "account 123456789012", "", "nothing here", "a@b.co1@c.de x@y.zz", "é555-123-4567", "john@bank.com,jane@bank.com",
    "mark \x01 with john@bank.com \x01", "12345678901 555.123.4567", "@ @@ a@ @b.com", None,
]


def test_mask_text(spark):
    df = spark.createDataFrame([(s,) for s in MASK_SAMPLES], "t string")
    masked = values(df.select(text.mask_text(F.col("t")).alias("m")), "m")
    assert masked == [None if s is None else python_mask(s) for s in MASK_SAMPLES]
    assert masked[0] == "Email: jo*********om"
    assert all(len(m) == len(s) for m, s in zip(masked, MASK_SAMPLES) if s is not None)
    short = df.limit(1).select(text.mask_text(F.lit("abcd abcde"), {"w": r"\b[a-e]{4,5}\b"}, "#").alias("m"))
    assert one(short).m == "#### ab#de"


def test_mask_columns(spark):
    df = spark.createDataFrame(
        [(7, "j@bank.com", ("pw", "j@bank.com", ("deep",)), ["j@bank.com"], {"api_token": "x", "mail": "j@bank.com"})],
        "c_custkey long, mail string, nested struct<password:string,mail:string,more:struct<secret:string>>, "
        "tags array<string>, extra map<string,string>")
    row = one(text.mask_columns(df))
    assert row.c_custkey == text.MASKED and row.mail == python_mask("j@bank.com")
    assert row.nested.password == text.MASKED and row.nested.mail == row.mail and row.nested.more.secret == text.MASKED
    assert row.tags == ["j@bank.com"]
    assert row.extra == {"api_token": text.MASKED, "mail": row.mail}
    own = one(text.mask_columns(df.select("c_custkey", "mail"), ["mail"]))
    assert own.c_custkey == 7 and own.mail == text.MASKED


def test_entities(spark):
    note = "Pay $1,200.50 and $5 on 1/2/2024 or 03-04-24 (12.5%, 3%) to a.b@c.org; ref 123-45-0007 and $1,200.50"
    df = spark.createDataFrame([(1, note), (2, ""), (3, "x")], "doc_id long, text string")
    found = {r.doc_id: r for r in text.extract_entities(df, "text").collect()}
    assert found[1].amounts == ["$1,200.50", "$5", "$1,200.50"]
    assert found[1].dates == ["1/2/2024", "03-04-24", "23-45-0007"]
    assert found[1].percentages == ["12.5%", "3%"] and found[1].emails == ["a.b@c.org"]
    assert found[1].entity_count == 9 and found[2].entity_count == 0
    assert one(text.entity_counts(df, "text")).entity_count == 9


def test_compare_documents(spark):
    df = spark.createDataFrame([("a b c", "B c d"), ("", ""), ("x x  x", "x"), ("a", "")], "a string, b string")
    sets = df.select(text.word_set(F.col("a")).alias("a"), text.word_set(F.col("b")).alias("b"))
    rows = text.similarity_columns(text.compare_sets(sets, "a", "b")).collect()
    assert [r.similarity_score for r in rows] == [0.5, 0.0, 1.0, 0.0]
    assert rows[0].summary == "Documents are 50.0% similar"
    assert (rows[0].common_terms_count, rows[0].unique_to_a, rows[0].unique_to_b) == (2, 1, 1)
    swapped = text.similarity_columns(text.compare_sets(sets, "b", "a")).collect()
    assert [r.similarity_score for r in swapped] == [r.similarity_score for r in rows]


def test_classify(spark):
    samples = {"A refund was paid": "investment_product", "Unit Trust": "investment_product", "KYC and risk": "kyc_document",
               "transaction risk": "transaction_record", "RISK": "risk_assessment", "": "general"}
    df = spark.createDataFrame([(s,) for s in samples], "text string")
    assert values(text.classify_document(df, "text"), "document_type") == list(samples.values())


def test_route(spark):
    df = spark.createDataFrame([("Look up the profile of Brian",), ("Recommend compliant funds for customer X: compliance",), ("hi",)], "text string")
    rows = text.route_turns(df, "text").collect()
    assert [(r.specialist, r.routing) for r in rows] == [
        ("customer_specialist", "direct"), ("customer_specialist", "sequential"), (None, "none")]
    assert rows[1].specialists == ["customer_specialist", "product_specialist", "compliance_officer"]


def test_summarize(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(60)) + ". Two! Three?",), ("",)], "text string")
    long, empty = text.summarize(df, "text", focus_areas=["fees"]).collect()
    assert (long.original_word_count, long.summary_word_count, len(long.summary.split())) == (62, 50, 50)
    assert long.key_points[1:] == ["Two", "Three"] and long.focus_areas_addressed == ["fees"]
    assert empty.original_word_count == 0 and empty.summary == ""
    assert text.summarize(df, "text", "odd").first().summary_word_count == 100


def test_extract_tables(spark):
    page = "Intro, text\n| a | b |\n| 1 | 2 |\nprose\nx,y,z\r\n1,2,3\n4,5\n| lonely | row |"
    df = spark.createDataFrame([(1, page), (2, "no table")], "doc_id long, text string")
    first, second = text.extract_tables(df, "doc_id", "text").orderBy("table_index").collect()
    assert (first.rows, first.columns, first.data) == (2, 2, [["a", "b"], ["1", "2"]])
    assert (second.rows, second.columns, second.data) == (2, 3, [["x", "y", "z"], ["1", "2", "3"]])
    csv = text.extract_tables(df, "doc_id", "text", "csv").orderBy("table_index").first()
    markdown = text.extract_tables(df, "doc_id", "text", "markdown").orderBy("table_index").first()
    assert csv.content == "a,b\n1,2" and markdown.content == "| a | b |\n| 1 | 2 |" and csv.format == "csv"


def test_detect_pii(spark):
    df = spark.createDataFrame([("john@bank.com 5551234567",), ("none",), ("",)], "text string")
    rows = text.detect_pii(df, "text").collect()
    assert (rows[0].email_count, rows[0].phone_count, rows[0].account_number_count, rows[0].pii_found) == (1, 1, 1, True)
    assert not rows[1].pii_found and not rows[2].pii_found


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 2.0, 2.0], [1.0])], "a array<double>, b array<double>")
    got = values(df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")), "c")
    assert got == pytest.approx([1 / math.sqrt(2), 0.0, 1 / 3])


def test_keys(spark):
    df = spark.createDataFrame([(1, None, '{"k": 5, "o": {"p": "q"}}')], "b long, a string, j string")
    row = one(keys.request_key(df, ["b", "a"]))
    assert row.request_key == one(keys.request_key(df, ["a", "b"])).request_key
    assert row.request_key == one(df.select(F.md5(F.lit('{"a":null,"b":1}')).alias("k"))).k
    assert one(keys.json_field(df, "j", "$.o.p", "p")).p == "q"
    assert one(keys.json_field(df, "j", "$.o.p", "p", "bigint")).p is None
    assert len(one(df.select(keys.summarize_result(F.repeat(F.lit("x"), 600)).alias("s"))).s) == 500


def test_search_products_filters(spark):
    rows = [(1, 1, "USD"), (2, 3, "usd"), (3, 5, "USD"), (4, 2, "GBP")]
    table = spark.createDataFrame(rows, "product_id long, risk_rating int, currency string")
    scored = table.select("product_id", (F.lit(1.0) / F.col("product_id")).alias("relevance_score"))
    assert values(products.search_products(table, scored, 0, ""), "product_id") == [1, 2, 3, 4]
    assert values(products.search_products(table, scored, None, None), "total_results") == [4] * 4
    assert values(products.search_products(table, scored, 3), "product_id") == [1, 2, 4]
    assert values(products.search_products(table, scored, currency="USD"), "product_id") == [1, 3]
    limited = products.search_products(table, scored, 5, limit=2).collect()
    assert [r.product_id for r in limited] == [1, 2] and limited[0].total_results == 4


def test_suitable_products_plan_has_no_nested_loop(spark):
    people = spark.createDataFrame([(1, 3), (2, 1), (3, 9)], "customer_id long, risk_rating int")
    table = spark.createDataFrame([(i, f"p{i}", i % 5 + 1, i / 10) for i in range(20)],
                                  "product_id long, product_name string, risk_rating int, expense_ratio double")
    result = products.suitable_products(people, table, 2)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {}
    for r in result.orderBy("customer_id", "rank").collect():
        got.setdefault(r.customer_id, []).append((r.product_id, r.suitable_products))
    assert got == {1: [(0, 12), (1, 12)], 2: [(0, 4), (5, 4)], 3: [(0, 20), (1, 20)]}


def test_compare_products_matrix(spark):
    metrics = spark.createDataFrame([(1, 5.0, 1.49, 12.5, 0.3), (2, 3.0, 0.99, 7.8, 0.1)],
                                    "product_id long, risk_rating double, expense_ratio double, `1y_return` double, volatility double")
    wide = {r.metric: r for r in products.comparison_matrix(metrics, [1, 2]).collect()}
    assert wide["expense_ratio"]["1"] == 1.49 and wide["1y_return"]["2"] == 7.8
    assert products.compare_products(metrics, metrics.select("product_id")).count() == 8
    assert products.compare_products(metrics, list(range(5000))).count() == 8


def test_lookup_and_aggregate(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0), (3, "a", 4.0)], "id long, g string, v double")
    assert values(lookup.lookup(df, "g", "a", ["id"]).orderBy("id"), "id") == [1, 3]
    assert values(lookup.lookup(df, "id", [2, 3], ["g"]).orderBy("g"), "g") == ["a", "b"]
    assert lookup.lookup(df, "g", "a' OR '1'='1", ["id"]).count() == 0
    agg = lookup.aggregate_table(df, "g", {"n": "count(*)", "total": "sum(v)"}, "a")
    assert one(agg).asDict() == {"g": "a", "n": 2, "total": 6.0}
    assert lookup.aggregate_table(df, "g", {"n": "count(*)"}, "").count() == 2


def test_allocation_sums_to_100(spark):
    rows = [(c, f"k{i % 4}", float(i * 7 % 13 + 1)) for c in range(5) for i in range(20)]
    shares = portfolio.portfolio_allocation(spark.createDataFrame(rows, "customer_id long, asset_class string, value double"))
    for r in shares.groupBy("customer_id").agg(F.sum("allocation").alias("s")).collect():
        assert r.s == pytest.approx(100)


def test_mapping_analysis_of_no_risks(spark):
    risks = spark.createDataFrame([], "risk_id long")
    links = spark.createDataFrame([(1, 1)], "risk_id long, control_id long")
    assert tuple(one(risk_control.mapping_analysis(risks, links))) == (0, 0, 0)


def test_coverage_and_effectiveness(spark):
    risks = spark.createDataFrame([(i, "ops", "High") for i in range(15)], "risk_id long, category string, level string")
    links = spark.createDataFrame([(i, 1) for i in range(12)], "risk_id long, control_id long")
    assert one(risk_control.control_coverage(risks, links)).coverage_percentage == 80.0
    assert one(risk_control.control_coverage(risks, links, "none")).coverage_percentage is None
    tests = spark.createDataFrame([(1, i < 2, "Q4 2024") for i in range(25)], "control_id long, exception boolean, period string")
    controls = spark.createDataFrame([(1, 90.0)], "control_id long, design_score double")
    row = one(risk_control.control_effectiveness(tests, controls))
    assert (row.samples_tested, row.exceptions_found, row.exception_rate, row.assessment_period) == (25, 2, 0.08, "Q4 2024")
    assert row.effectiveness_score == 91.0


def test_sar_drafts(spark):
    alerts = spark.createDataFrame([(1, 5), (1, 3), (1, 5), (2, None)], "customer_id long, transaction_id long")
    rows = {r.customer_id: r for r in compliance.sar_drafts(alerts, "2024-01-20").collect()}
    assert rows[1].transaction_count == 2 and rows[2].transaction_count == 0
    assert sorted(r.transaction_id for r in compliance.sar_transactions(alerts, "2024-01-20").collect()) == [3, 5]
    assert rows[1].report_id == "SAR-20240120-1" and rows[1].filing_deadline == datetime.date(2024, 2, 4)
    signed = ["authorized_signatory", "compliance_officer_review"]
    assert rows[1].missing_fields == ["narrative", *signed] and rows[2].missing_fields == ["narrative", "transactions", *signed]
    told = spark.createDataFrame([(1, "text", "A", "B")], "customer_id long, narrative string, authorized_signatory string, "
                                 "compliance_officer_review string")
    full = {r.customer_id: r for r in compliance.sar_drafts(alerts, "2024-01-20", told).collect()}
    assert full[1].required_fields_complete and full[1].missing_fields == [] and not full[2].required_fields_complete


def test_ratings_of_any_range_find_products(spark):
    people = spark.createDataFrame([(1, 6), (2, 3), (3, -1), (4, None)], "customer_id long, risk_rating int")
    table = spark.createDataFrame([(1, "a", 6, 0.3), (2, "b", 0, 0.2), (3, "c", 2, 0.1)],
                                  "product_id long, product_name string, risk_rating int, expense_ratio double")
    found = {(r.customer_id, r.product_id, r.suitable_products) for r in products.suitable_products(people, table, 5).collect()}
    assert found == {(1, 1, 3), (1, 2, 3), (1, 3, 3), (2, 2, 2), (2, 3, 2)}


def test_unknown_pairs_stay(spark):
    who = spark.createDataFrame([(1, 3, "USD")], "customer_id long, risk_rating int, preferred_currency string")
    what = spark.createDataFrame([(1, 2, "EUR")], "product_id long, risk_rating int, currency string")
    pairs = spark.createDataFrame([(1, 1), (1, 9), (9, 1)], "customer_id long, product_id long")
    rows = {(r.customer_id, r.product_id): r for r in products.assess_suitability(pairs, who, what).collect()}
    assert {k: r.suitability_status for k, r in rows.items()} == {(1, 1): "SUITABLE", (1, 9): "UNKNOWN", (9, 1): "UNKNOWN"}
    assert len(rows[1, 1].factors_considered) == 2 and rows[1, 9].factors_considered == []


def test_levels_and_thresholds_use_unrounded_values(spark):
    names = ("geographic_risk", "product_risk", "channel_risk", "customer_type_risk", "tenure_risk", "transaction_behavior_risk")
    factors = spark.createDataFrame([(1, 29.996, 0.0, 0.0, 0.0, 0.0, 0.0)], "customer_id long, " + ", ".join(f"{n} double" for n in names))
    row = one(customers.customer_risk_score(factors, "2024-01-01"))
    assert (row.risk_score, row.risk_level) == (30.0, "LOW")
    rounded = spark.createDataFrame([(1.0049996,), (1.005,), (1e40,), (None,)], "v double").select(round_half_up(F.col("v"), 2).alias("v"))
    assert [r.v for r in rounded.collect()] == [1.0, 1.01, 1e40, None]
    angle = math.acos(0.9499996)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    vectors = spark.createDataFrame([(1, [math.cos(angle), math.sin(angle)])], "vec_id long, embedding array<double>")
    assert search.vector_search(queries, vectors, 1, 0.95).count() == 0
    assert search.vector_search(queries, vectors, 1, 0.9499).count() == 1


def test_audit_details_of_any_form_are_kept(spark):
    details = ["free text", '{"acct": 12345678901, "mail": "ab@example.com"}', '{"api_key": "x1", "token": 5, "in": {"password": "p", "n": [1, "t"]}}',
               'say "hi" \\ there', None, "[1, 2]"]
    rows = spark.createDataFrame([(i, d, datetime.datetime(2024, 1, 2)) for i, d in enumerate(details)],
                                 "i long, details string, timestamp timestamp").repartition(1)
    shown = [json.loads(r.audit_json)["details"] for r in audit.to_audit_json(rows).collect()]
    assert shown == ["free text", json.loads(details[1]), json.loads(details[2]), details[3], {}, [1, 2]]
    masked = [r.details for r in masked_entries(rows).collect()]
    again = [json.loads(r.audit_json)["details"] for r in audit.to_audit_json(masked_entries(rows)).collect()]
    assert again[0] == "free text" and again[5] == [1, 2]
    assert again[1]["acct"] == 12345678901 and "ab@example.com" not in masked[1] and set(again[1]) == {"acct", "mail"}
    hidden = "***MASKED***"
    assert again[2] == {"api_key": hidden, "token": hidden, "in": {"password": hidden, "n": [1, "t"]}}


def test_json_values_are_masked_as_parsed(spark):
    hidden = "***MASKED***"
    cases = {
        '{"note": "call\\n415-555-1234"}': {"note": "call\n41********34"},
        '{"card": "\\t4111-1111-1111-1111\\t"}': {"card": "\t41***************11\t"},
        '{"mail": "\\njohn@bank.com"}': {"mail": "\njo*********om"},
        '{"m": "\\u006aohn@bank.com \\"q\\" \\\\ é"}': {"m": 'jo*********om "q" \\ é'},
        '{"token": ["abc123"], "password": {"value": "hunter2"}, "API_KEY": null, "secret": 5}':
            {"token": hidden, "password": hidden, "API_KEY": hidden, "secret": hidden},
        '[{"a": ["123-45-6789", 1234567890, true, null]}, "1234567890"]': [{"a": ["12*******89", 1234567890, True, None]}, "12******90"],
        '{"x": {"y": {"z": [{"ssn": 1, "w": "12345678901"}]}}}': {"x": {"y": {"z": [{"ssn": hidden, "w": "12*******01"}]}}},
        "[" * 100_000: None, "{}": {}, "[]": [], '{"open": ': None,
    }
    rows = spark.createDataFrame([(i, d, datetime.datetime(2024, 1, 2)) for i, d in enumerate(cases)],
                                 "i long, details string, timestamp timestamp").repartition(1)
    got = [r.details for r in masked_entries(rows).orderBy("i").collect()]
    for shown, (given, expected) in zip(got, cases.items()):
        if expected is not None:
            assert json.loads(shown) == expected, given
    plain = ["4155551234", '"415-555-1234"', "mail a.b@c.de {", None, ""]
    rows = spark.createDataFrame([(p,) for p in plain], "t string")
    assert [r[0] for r in rows.select(text.mask_json(F.col("t"))).collect()] == ["41******34", '"41********34"', "mail a.****de {", None, ""]


def test_arguments_with_dotted_names(spark):
    schema = {"properties": {"a.b": {"type": "integer"}, "c": {"type": "string"}}, "required": ["a.b"]}
    calls = spark.createDataFrame([('{"a.b": 3}',), ('{"c": "x"}',), ('{"a.b": "no"}',), ("not json",)], "args_json string")
    rows = audit.validate_json_args(calls, "args_json", schema).collect()
    assert [r.valid for r in rows] == [True, False, False, False]
    assert rows[0].args["a.b"] == 3 and rows[1].missing == ["a.b"] and rows[2].mistyped == ["a.b"]


def test_csv_cells_are_quoted(spark):
    docs = spark.createDataFrame([(1, '| a | 1,000 |\n| "q" | 2 |')], "doc_id long, text string")
    assert one(text.extract_tables(docs, "doc_id", "text", "csv")).content == 'a,"1,000"\n"""q""",2'


def test_audit_json_and_query(spark):
    ts = datetime.datetime(2024, 1, 2, 3, 4, 5)
    df = spark.createDataFrame([(ts, "a", "u", None, None), (ts.replace(microsecond=7), "b", "v", "c", '{"k": [1, "x"]}')],
                               "timestamp timestamp, action string, user_id string, customer_id string, details string")
    first, second = values(audit.to_audit_json(df), "audit_json")
    assert first == ('{"timestamp":"2024-01-02T03:04:05","action":"a","user_id":"u","customer_id":null,"details":{},'
                     '"ip_address":null,"session_id":null,"status":"success"}')
    assert '"timestamp":"2024-01-02T03:04:05.000007"' in second and '"details":{"k":[1,"x"]}' in second
    assert audit.query_audit(df, start="2024-01-02 03:04:05", end="2024-01-02 03:04:05").count() == 1
    assert audit.query_audit(df, action="", user_id=None).count() == 2


def test_structured_json_precedence(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 1), "m", "row", None)], "timestamp timestamp, msg string, user string, note string")
    line = one(audit.structured_json(df, "timestamp", "msg", {"user": "ctx", "message": "over"}, ["user", "note"])).log_json
    assert line == '{"timestamp":"2024-01-01T00:00:00","message":"over","user":"row","note":null}'


def test_audit_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, d), "a", str(d)) for d in (1, 2, 2)], "timestamp timestamp, action string, user_id string")
    path = str(tmp_path / "audit")
    audit.write_audit(df, path)
    audit.write_audit(df, path)
    back = audit.read_audit(spark, path)
    assert back.count() == 6 and set(values(back, "status")) == {"success"}
    found = audit.query_audit(back, start="2024-01-02")
    assert found.count() == 4
    assert "PartitionFilters: [isnotnull(date" in found._jdf.queryExecution().executedPlan().toString()


def test_validate_json_args(spark):
    schema = {"properties": {"amount": {"type": "number"}, "currency": {"type": "string"}, "flag": {"type": "boolean"}},
              "required": ["amount", "currency"]}
    df = spark.createDataFrame([('{"amount": 5.5, "currency": "USD"}',), ('{"amount": 5.5}',), ('{"amount": "x", "currency": "USD"}',), ("oops",)], "j string")
    rows = audit.validate_json_args(df, "j", schema).collect()
    assert [r.valid for r in rows] == [True, False, False, False]
    assert rows[0].args.asDict() == {"amount": 5.5, "currency": "USD", "flag": None}
    assert rows[1].missing == ["currency"] and rows[2].mistyped == ["amount"]
    empty = audit.validate_json_args(df.limit(1), "j", {}).first()
    assert empty.valid and empty.missing == []


def test_validate_json_args_with_odd_names(spark):
    names = ["o'clock", 'say "x"', "a]b", "a.b", "$"]
    schema = {"properties": {n: {"type": "integer"} for n in names}, "required": names}
    df = spark.createDataFrame([(1, json.dumps({n: i for i, n in enumerate(names)})), (2, json.dumps({n: None for n in names})),
                                (3, json.dumps({names[0]: {"k": 1}, **{n: 7 for n in names[1:]}})), (4, "[1]"), (5, None)], "i int, j string")
    rows = audit.validate_json_args(df, "j", schema).orderBy("i").collect()
    assert [r.valid for r in rows] == [True, False, False, False, False]
    assert rows[0].args.asDict() == {n: i for i, n in enumerate(names)}
    assert rows[1].missing == names and rows[2].missing == [] and rows[2].mistyped == [names[0]]


def test_conversations(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(20)] + [(2, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    threads = {r.conv_id: r.messages for r in conversations.assemble_threads(df).collect()}
    assert [m.turn for m in threads[1]] == list(range(15)) and len(threads[2]) == 1
    assert {r.conv_id: r.reply for r in conversations.last_reply(df).collect()} == {1: "t19", 2: ""}
    stats = {r.conv_id: (r.input_messages, r.output_messages) for r in conversations.thread_stats(df).collect()}
    assert stats == {1: (10, 10), 2: (1, 0)}


def test_conversation_append_and_export(spark, tmp_path):
    history = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    new = spark.createDataFrame([(1, 5, "assistant", "b"), (2, 5, "user", "c")], history.schema)
    merged = conversations.append_turns(history, new).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.turn) for r in merged] == [(1, 0), (1, 1), (2, 0)]
    path = str(tmp_path / "export")
    conversations.export_conversations(history, path, "2024-01-01T00:00:00")
    assert spark.read.text(path).first().value == (
        '{"exported_at":"2024-01-01T00:00:00","conv_id":1,"messages":[{"role":"user","content":"a"}]}')


def test_dimensions(spark):
    assert dimensions.fx_rates(spark).count() == 6 and dimensions.thresholds(spark).count() == 6
    assert dimensions.doc_rules(spark).count() == 6 and dimensions.routing_rules(spark).count() == 18
