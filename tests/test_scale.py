"""Hot keys, block-wise paths and order-dependent rules against brute force."""

import datetime
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientlens.operators import admission, compliance, customers, graph, risk_control, screening, search
from clientlens.operators.admission import NEVER, Bucket, Lifetime, _apply

EPOCH = datetime.datetime(2024, 1, 1)


# --- token bucket and time to live -------------------------------------------------

def plain_bucket(times, size, rate, cost):
    """The rule as stated, in exact fractions."""
    tokens, last, out = Fraction(str(size)), None, []
    for t in times:
        if last is not None:
            tokens = min(Fraction(str(size)), tokens + Fraction(t - last, 10**6) * Fraction(str(rate)))
        last = t
        admit = tokens >= Fraction(str(cost))
        tokens -= Fraction(str(cost)) if admit else 0
        out.append((admit, float(tokens)))
    return out


def plain_ttl(times, ttl):
    opened, out = None, []
    for t in times:
        hit = opened is not None and t - opened <= ttl
        opened = opened if hit else t
        out.append((hit, opened))
    return out


def test_pieces_equal_runs():
    rng = random.Random(5)
    for _ in range(400):
        size, rate, cost = rng.choice([1, 2, 5, 2.5]), rng.choice([1, 0.5, 10]), rng.choice([1, 1, 2, 0.5])
        bucket = Bucket.of(size, rate, cost)
        n = rng.randint(1, 30)
        span = rng.choice([0.05, 0.3, 1, 3]) * 1e6 * size / rate * n / 5
        times = np.sort(np.array([int(rng.random() * span) for _ in range(n)]))
        pieces = bucket.pieces(times)
        for x in [0, bucket.capacity, *[rng.randint(0, bucket.capacity) for _ in range(10)]]:
            assert _apply(*pieces, x) == bucket.run(times, x)[2]
        life = Lifetime(rng.randint(1, 100))
        times = np.sort(np.array([rng.randint(1000, 1300) for _ in range(n)]))
        pieces = life.pieces(times)
        for x in [NEVER, *[rng.randint(int(times[0]) - 200, int(times[0]) - 1) for _ in range(10)]]:
            assert _apply(*pieces, x) == life.run(times, x)[1][-1]


def hot_events(spark, seed, n=900, span=3600):
    """A third of the rows belong to one key; many share a timestamp."""
    rng = random.Random(seed)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randint(0, 40)}", rng.randrange(span * 4) * 250_000) for i in range(n)]
    df = spark.createDataFrame([(i, k, EPOCH + datetime.timedelta(microseconds=t)) for i, k, t in rows],
                               "event_id long, user_id string, timestamp timestamp")
    return rows, df


@pytest.mark.parametrize("size, rate, cost, slot, load", [(3, 0.01, 1, 120, 100), (5, 10, 1, 86_400, 5), (2.5, 0.1, 0.5, 120, 3),
                                                          (1, 1, 2, 86_400, 1)])
def test_rate_limit_equals_brute_force(spark, monkeypatch, size, rate, cost, slot, load):
    monkeypatch.setattr(admission, "FANOUT", 4)
    rows, df = hot_events(spark, 3)
    limited = admission.rate_limit(df, "user_id", max_tokens=size, refill_rate=rate, cost=cost, slot_seconds=slot, rows_per_slot=load)
    got = {r.event_id: (r.admitted, r.tokens_left) for r in limited.collect()}
    assert len(got) == len(rows)
    for key in {k for _, k, _ in rows}:
        mine = sorted((t, i) for i, k, t in rows if k == key)
        for (_, i), (admit, left) in zip(mine, plain_bucket([t for t, _ in mine], size, rate, cost)):
            assert got[i][0] == admit and got[i][1] == pytest.approx(left)


def test_admissions_are_bounded(spark):
    _, df = hot_events(spark, 4)
    for r in (admission.rate_limit(df, "user_id", max_tokens=3, refill_rate=0.01, slot_seconds=60).where("admitted")
              .groupBy("user_id").count().collect()):
        assert r["count"] <= 3 + 0.01 * 3600


@pytest.mark.parametrize("ttl, slot, load", [(60, 120, 100), (600, 86_400, 4), (3600, 300, 2)])
def test_ttl_equals_brute_force(spark, monkeypatch, ttl, slot, load):
    monkeypatch.setattr(admission, "FANOUT", 4)
    rows, df = hot_events(spark, 6)
    marked = admission.ttl_repeats(df, "user_id", ttl=ttl, slot_seconds=slot, rows_per_slot=load)
    base = int(EPOCH.replace(tzinfo=datetime.timezone.utc).timestamp()) * 10**6
    got = {r.event_id: (r.hit, r.opened_us - base) for r in marked.collect()}
    for key in {k for _, k, _ in rows}:
        mine = sorted((t, i) for i, k, t in rows if k == key)
        assert [got[i] for _, i in mine] == plain_ttl([t for t, _ in mine], ttl * 10**6)


def test_composition_equals_both_in_turn():
    rng = random.Random(8)
    for _ in range(300):
        bucket = Bucket.of(rng.choice([1, 3, 2.5]), rng.choice([0.5, 10]), rng.choice([1, 0.5]))
        steps = [bucket.pieces(np.sort(np.array([int(rng.random() * 2e6) for _ in range(rng.randint(1, 12))]))) for _ in range(2)]
        gap = rng.choice([0, 1000, 400_000, 10**8])
        whole = admission._compose(admission._compose(steps[0], bucket.carried(gap)), steps[1])
        for x in [0, bucket.capacity, *[rng.randint(0, bucket.capacity) for _ in range(8)]]:
            assert _apply(*whole, x) == _apply(*steps[1], bucket.refill(_apply(*steps[0], x), gap))
        life = Lifetime(rng.randint(1, 100))
        parts = [life.pieces(np.sort(np.array([rng.randint(a, a + 150) for _ in range(9)]))) for a in (1000, 1160)]
        whole = admission._compose(admission._compose(parts[0], life.carried(5)), parts[1])
        for x in [NEVER, *range(850, 1000, 7)]:
            assert _apply(*whole, x) == _apply(*parts[1], _apply(*parts[0], x))


def test_dense_minute_of_a_hot_key_is_cut_by_load(spark):
    """A third of all rows are one key's within one minute; a tenth of those share a microsecond."""
    n, base = 30_000, 1_704_067_200_000_000
    hot = F.col("id") % 3 == 0
    times = F.when(hot & (F.col("id") % 10 == 0), 7).when(hot, F.pmod(F.xxhash64("id"), F.lit(60_000_000))).otherwise(
        F.pmod(F.xxhash64("id"), F.lit(86_400_000_000)))
    df = spark.range(0, n, 1, 8).select(F.col("id").alias("event_id"), F.when(hot, -1).otherwise(F.col("id") % 400).alias("user_id"),
                                        F.timestamp_micros(F.lit(base) + times).alias("timestamp"))
    rows = df.withColumn("_us", F.unix_micros("timestamp"))
    placed, spans = admission._slots_by_load(rows, ["user_id"], 86_400 * 10**6, 500)
    counts = [r["count"] for r in placed.groupBy("user_id", "_slot").count().where("user_id = -1").collect()]
    assert len(counts) >= 20 and sum(counts) == n // 3
    assert sorted(counts)[-2] <= 500 and max(counts) == 1000  # the shared microsecond can't be cut
    assert spans.count() == placed.select("user_id", "_slot").distinct().count()
    limited = admission.rate_limit(df, "user_id", max_tokens=100, refill_rate=50, rows_per_slot=500)
    got = {r.event_id: r.admitted for r in limited.collect()}
    mine = sorted((r._us, r.event_id) for r in rows.where("user_id = -1").collect())
    bucket = Bucket.of(100, 50, 1)
    assert [got[i] for _, i in mine] == bucket.run(np.array([t for t, _ in mine]), bucket.capacity)[0].tolist()
    marked = {r.event_id: r.hit for r in admission.ttl_repeats(df, "user_id", ttl=3, rows_per_slot=500).collect()}
    assert [marked[i] for _, i in mine] == [hit for hit, _ in plain_ttl([t for t, _ in mine], 3 * 10**6)]


def test_hot_key_over_many_batches(spark):
    """Slots larger than an Arrow batch, and side tables small enough to be broadcast at run time."""
    n = 60_000
    times = F.pmod(F.xxhash64("id"), F.lit(5 * 86_400 * 1_000_000))
    df = spark.range(0, n, 1, 8).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 500).alias("user_id"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + times).alias("timestamp"))
    micros = df.select("event_id", "user_id", F.unix_micros("timestamp").alias("us")).collect()
    limited = {r.event_id: r.admitted for r in admission.rate_limit(df, "user_id", max_tokens=10, refill_rate=0.02).collect()}
    marked = {r.event_id: (r.hit, r.opened_us) for r in admission.ttl_repeats(df, "user_id", ttl=600, slot_seconds=43_200).collect()}
    counts = admission.rate_limit(df, "user_id", max_tokens=10, refill_rate=0.02).count()
    assert counts == n and len(limited) == n and len(marked) == n
    mine = sorted((r.us, r.event_id) for r in micros if r.user_id == 0)
    order = [t for t, _ in mine]
    assert [limited[i] for _, i in mine] == Bucket.of(10, 0.02, 1).run(np.array(order), Bucket.of(10, 0.02, 1).capacity)[0].tolist()
    assert [marked[i] for _, i in mine] == plain_ttl(order, 600 * 10**6)


def test_ttl_boundary(spark):
    times = [0, 10, 11, 22]
    df = spark.createDataFrame([(i, "k", EPOCH + datetime.timedelta(seconds=t)) for i, t in enumerate(times)],
                               "event_id long, user_id string, timestamp timestamp")
    kept = admission.ttl_dedup(df, "user_id", ttl=10).orderBy("event_id").collect()
    assert [r.event_id for r in kept] == [0, 2, 3]


# --- hot groups ------------------------------------------------------------------------

def test_a_busy_customer_has_one_report(spark):
    alerts = spark.range(500).select(F.lit(1).alias("customer_id"), F.col("id").alias("transaction_id"))
    drafts = compliance.sar_drafts(alerts.union(alerts), "2024-01-01").collect()
    assert [(d.report_id, d.transaction_count) for d in drafts] == [("SAR-20240101-1", 500)]
    details = compliance.sar_transactions(alerts.union(alerts), "2024-01-01").collect()
    assert sorted(t.transaction_id for t in details) == list(range(500)) and {t.report_id for t in details} == {"SAR-20240101-1"}


def test_risk_with_many_controls(spark):
    links = spark.range(300).select(F.lit(1).alias("risk_id"), F.col("id").alias("control_id"))
    controls = spark.range(300).select(F.col("id").alias("control_id"), F.lit("Preventive").alias("control_type"), F.lit("Effective").alias("effectiveness"))
    risks = spark.createDataFrame([(1,), (2,)], "risk_id long")
    rows = risk_control.map_risks_to_controls(risks, links).collect()
    assert sorted((r.risk_id, r.control_count, r.control_coverage) for r in rows) == [(1, 300, "Adequate"), (2, 0, "None")]
    assert risk_control.risk_controls(links, controls.where("control_id < 7")).where("control_type IS NULL").count() == 293



def test_transaction_profile_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, 1 if i % 3 == 0 else rng.randint(2, 9), rng.choice([100.0, 120.0, 90.0, 150000.0]), rng.randrange(400)) for i in range(600)]
    df = spark.createDataFrame([(i, c, a, EPOCH + datetime.timedelta(days=d, hours=i % 24)) for i, c, a, d in rows],
                               "transaction_id long, customer_id long, amount double, ts timestamp")
    got = {r.customer_id: r for r in customers.transaction_profile(df, "2024-12-31").collect()}
    for c in got:
        mine = [(d, a) for _, who, a, d in rows if who == c]
        large = [d for d, a in mine if a >= 100000]
        assert got[c].large_transactions_30d == sum(1 for d in large if 335 < d <= 365)
        assert got[c].peak_large_30d == max([sum(1 for x in large if d - 30 < x <= d) for d, _ in mine])
        months = {(EPOCH + datetime.timedelta(days=d)).strftime("%Y%m") for d, _ in mine}
        assert got[c].avg_monthly_volume == pytest.approx(sum(a for _, a in mine) / len(months), abs=0.01)
        odd = False
        for d in sorted({d for d, _ in mine}):
            before = [a for x, a in mine if x < d]
            if len(before) >= 2 and max(a for x, a in mine if x == d) > np.mean(before) + 3 * np.std(before, ddof=1):
                odd = True
        assert got[c].unusual_patterns == odd


# --- names --------------------------------------------------------------------------------

def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[j - 1] + 1, left[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("distance", [0, 1, 2])
def test_matching_names_equals_brute_force(spark, distance):
    rng = random.Random(distance)
    names = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(60)})
    listed = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(40)})
    found = screening.matching_names(spark.createDataFrame([(n,) for n in names], "name string"),
                                     spark.createDataFrame([(n,) for n in listed], "listed string"), distance)
    expected = {(a, b, levenshtein(a, b)) for a in names for b in listed if levenshtein(a, b) <= distance}
    assert {tuple(r) for r in found.collect()} == expected


def test_keys_of_names_are_not_broadcast(spark):
    rng = random.Random(7)
    names = sorted({f"CUSTOMER {rng.randrange(400):06d}{rng.choice(['', '', '7'])}" for _ in range(120)} | {"", "A", "AB"})
    listed = sorted({f"CUSTOMER {rng.randrange(400):06d}" for _ in range(40)} | {"B", "AC"})
    found = screening.matching_names(spark.createDataFrame([(n,) for n in names], "name string"),
                                     spark.createDataFrame([(n,) for n in listed], "listed string"), 2)
    rows = [tuple(r) for r in found.collect()]
    expected = {(a, b, levenshtein(a, b)) for a in names for b in listed if levenshtein(a, b) <= 2}
    assert len(rows) == len(set(rows)) and set(rows) == expected
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_screening_of_a_shared_name(spark):
    people = spark.range(200).select(F.col("id").alias("customer_id"), F.lit("Jon  Smith").alias("name"), F.lit("SG").alias("jurisdiction"))
    entries = spark.createDataFrame([(1, "JOHN SMITH", "UN", "SG"), (2, "john-smith", "UN", "SG"), (3, "Jane Roe", "EU", None)],
                                    "entry_id long, listed_name string, list_name string, country string")
    rows = screening.screen_names(people, entries, 1).collect()
    assert len(rows) == 200 and all(r.match_found and r.matches_found == 1 and r.screening_score == 0.9 for r in rows)
    assert rows[0].recommendation.startswith("REVIEW")


# --- vectors ----------------------------------------------------------------------------------

def vector_table(spark, n, d, seed, name):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, d))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    return data, spark.createDataFrame(rows, f"{name} long, embedding array<double>")


@pytest.mark.parametrize("blocks", [False, True])
def test_vector_search_equals_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(search, "CHUNK_VECTORS", 7)
        monkeypatch.setattr(search, "BLOCK_VECTORS", 20)
    q, queries = vector_table(spark, 25, 6, 1, "query_id")
    v, vectors = vector_table(spark, 150, 6, 2, "vec_id")
    scores = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T, 6)
    expected = {(i, int(j), r + 1) for i in range(25)
                for r, j in enumerate(sorted(np.flatnonzero(scores[i] >= 0.5), key=lambda j: (-scores[i, j], j))[:4])}
    found = search.vector_search(queries, vectors, 4, 0.5).collect()
    assert {(r.query_id, r.vector_id, r["rank"]) for r in found} == expected


def test_vector_search_of_odd_vectors(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    vectors = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0]), (3, [1.0, 0.0, 1.0])], "vec_id long, embedding array<double>")
    got = {r.vector_id: r.score for r in search.vector_search(queries, vectors, 5, 0.0).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: pytest.approx(0.707107)}


@pytest.mark.parametrize("blocks", [False, True])
def test_semantic_match_takes_the_first_entry(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(search, "CHUNK_VECTORS", 1)
        monkeypatch.setattr(search, "BLOCK_VECTORS", 2)
    store = spark.createDataFrame(
        [(1, "a", [1.0, 0.1], "first"), (2, "b", [1.0, 0.0], "nearer"), (3, "a", [1.0, 0.1], "again"), (4, "c", [0.0, 1.0], "other")],
        "insert_seq long, text string, embedding array<double>, response string")
    asked = spark.createDataFrame([(1, "b", [1.0, 0.0]), (2, "x", [1.0, 0.0]), (3, "y", [-1.0, 0.0]), (4, "z", None)],
                                  "query_id long, text string, embedding array<double>")
    got = {r.query_id: (r.match_type, r.response) for r in search.semantic_match(asked, store, 0.95).collect()}
    assert got == {1: ("exact", "nearer"), 2: ("semantic", "again"), 3: ("none", None), 4: ("none", None)}


# --- graph --------------------------------------------------------------------------------------

def test_semantic_match_reads_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text_of(number):
        read.add(1)
        return f"question {number}"

    asked = spark.range(40).select(F.col("id").alias("query_id"), text_of(F.col("id")).alias("text"),
                                   F.array(F.lit(1.0), F.col("id") / 40).alias("embedding"))
    store = spark.createDataFrame([(1, "question 3", [1.0, 0.0], "three"), (2, "other", [0.0, 1.0], "other")],
                                  "insert_seq long, text string, embedding array<double>, response string")
    rows = {r.query_id: r for r in search.semantic_match(asked, store, 0.9).collect()}
    assert rows[3].match_type == "exact" and rows[3].response == "three"
    assert [rows[i].match_type for i in (0, 1, 39)] == ["semantic", "semantic", "none"]
    assert read.value == 40


def test_paths_and_neighbourhood_equal_brute_force(spark):
    rng = random.Random(8)
    links = sorted({(f"n{rng.randint(0, 25)}", rng.choice("xy"), f"n{rng.randint(0, 25)}") for _ in range(70)})
    # A hub every node points to and that points to a third of them.
    links += [(f"n{i}", "up", "hub") for i in range(26)] + [("hub", "down", f"n{i}") for i in range(0, 26, 3)]
    edges = spark.createDataFrame(links + links[:5], "src string, rel string, dst string")

    def shortest(a, b, rels):
        level = [((a,), ())]
        for _ in range(4):
            done = [p for p in level if p[0][-1] == b]
            if done:
                return set(done)
            level = [(ns + (d,), rs + (r,)) for ns, rs in level for s, r, d in links if s == ns[-1] and d not in ns and (not rels or r in rels)]
        return {p for p in level if p[0][-1] == b}

    for a, b, rels in [("n1", "n7", None), ("n2", "n20", ["x", "y"]), ("n3", "n3", None), ("n4", "nowhere", ["x"])]:
        found = graph.find_paths(edges, a, b, rels).collect()
        assert {(tuple(r.nodes), tuple(r.relationships)) for r in found} == shortest(a, b, rels)

    reach, frontier = {"n1": 0}, {"n1"}
    for hop in (1, 2, 3):
        frontier = {d for s, _, d in links if s in frontier} - set(reach)
        reach.update(dict.fromkeys(frontier, hop))
    near, total = graph.reached_nodes(edges, spark.createDataFrame([("n1",)], "id string"), 3)
    assert {r.id: r.hop for r in near.collect()} == reach and total == len(reach)
