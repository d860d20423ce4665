"""Streams over files that arrive in steps."""

import datetime

from pyspark.sql import functions as F

from clientlens.functions.registry import catalog_function, register_function, sql_type
from clientlens.operators import admission
from clientlens.sources.tables import stream_table
from clientlens.streaming.admission import stream_rate_limit, stream_ttl_repeats
from clientlens.streaming.alerts import stream_alerts
from clientlens.streaming.audit import stream_audit

EPOCH = datetime.datetime(2024, 1, 1)
EVENTS = "event_id long, user_id string, timestamp timestamp"


def land(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def drain(df, out, checkpoint):
    query = (df.writeStream.format("parquet").outputMode("append").option("path", out)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def event_batches(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 7}", EPOCH + datetime.timedelta(seconds=(i * i) % 97 + i * 2)) for i in range(120)]
    rows.sort(key=lambda r: (r[2], r[0]))
    return rows, [spark.createDataFrame(rows[i:i + 40], EVENTS) for i in (0, 40, 80)]


def test_stream_rate_limit_equals_batch(spark, tmp_path):
    rows, batches = event_batches(spark)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    rule = {"max_tokens": 4, "refill_rate": 0.05}
    for batch in batches:
        land(batch, source)
        drain(stream_rate_limit(stream_table(spark, source, batch.schema), "user_id", **rule), out, checkpoint)
    expected = admission.rate_limit(spark.createDataFrame(rows, EVENTS), "user_id", slot_seconds=30, **rule)
    key = lambda r: r.event_id
    assert sorted(spark.read.parquet(out).select(expected.columns).collect(), key=key) == sorted(expected.collect(), key=key)


def test_stream_ttl_equals_batch(spark, tmp_path):
    rows, batches = event_batches(spark)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    for batch in batches:
        land(batch, source)
        drain(stream_ttl_repeats(stream_table(spark, source, batch.schema), "user_id", ttl=20), out, checkpoint)
    expected = admission.ttl_repeats(spark.createDataFrame(rows, EVENTS), "user_id", ttl=20, slot_seconds=15)
    key = lambda r: r.event_id
    assert sorted(spark.read.parquet(out).select(expected.columns).collect(), key=key) == sorted(expected.collect(), key=key)


def states(spark, checkpoint, name="state"):
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load().count()


def test_states_go_when_they_no_longer_matter(spark, tmp_path):
    """500 keys once, then one key alone: buckets that are full again and entries that have expired leave the store."""
    def at(seconds):
        return EPOCH + datetime.timedelta(seconds=seconds)

    steps = [[(i, f"k{i}", at(i % 50)) for i in range(500)], [(1000, "late", at(400))], [(1001, "late", at(401))]]
    for form in (lambda s: stream_rate_limit(s, "user_id", max_tokens=10, refill_rate=0.5, lateness="1 minute"),
                 lambda s: stream_ttl_repeats(s, "user_id", ttl=60, lateness="1 minute")):
        folder = tmp_path / form(spark.createDataFrame(steps[0], EVENTS)).columns[-1]
        source, out, checkpoint = (str(folder / n) for n in ("in", "out", "check"))
        sizes = []
        for step in steps:
            batch = spark.createDataFrame(step, EVENTS)
            land(batch, source)
            drain(form(stream_table(spark, source, batch.schema)), out, checkpoint)
            sizes.append(states(spark, checkpoint))
        assert sizes[0] == 500 and sizes[-1] == 1
        assert spark.read.parquet(out).count() == 502


def test_answers_in_time_order_whatever_the_arrival(spark, tmp_path):
    rows, _ = event_batches(spark)
    shuffled = sorted(rows, key=lambda r: (r[0] * 7919) % 120)
    last = (999, "end", rows[-1][2] + datetime.timedelta(hours=1))
    rule = {"max_tokens": 4, "refill_rate": 0.05}
    marks = {"answers": "time", "lateness": "10 minutes", "cell_seconds": 15}
    forms = {"bucket": (lambda s: stream_rate_limit(s, "user_id", **rule, **marks), lambda df: admission.rate_limit(df, "user_id", **rule)),
             "entry": (lambda s: stream_ttl_repeats(s, "user_id", ttl=20, **marks), lambda df: admission.ttl_repeats(df, "user_id", ttl=20))}
    for name, (stream, batch_form) in forms.items():
        source, out, checkpoint = (str(tmp_path / name / n) for n in ("in", "out", "check"))
        for part in (shuffled[:50], shuffled[50:90], shuffled[90:], [last]):
            batch = spark.createDataFrame(part, EVENTS)
            land(batch, source)
            drain(stream(stream_table(spark, source, batch.schema)), out, checkpoint)
        expected = batch_form(spark.createDataFrame(rows, EVENTS))
        got = spark.read.parquet(out).select(expected.columns).collect()
        assert sorted(got, key=lambda r: r.event_id) == sorted(expected.collect(), key=lambda r: r.event_id)
        assert states(spark, checkpoint, "waiting") == 1  # the last row still waits


def test_alerts_drop_late_rows(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "customer_id long, ts timestamp, amount double"

    def at(day, hour):
        return EPOCH + datetime.timedelta(days=day, hours=hour)

    steps = [[(1, at(0, 1), 100000.0), (1, at(0, 5), 60000.0), (1, at(1, 3), 5.0)], [(1, at(0, 7), 999999.0), (1, at(2, 2), 7.0)],
             [(1, at(3, 2), 1.0)]]
    for step in steps:
        batch = spark.createDataFrame(step, schema)
        land(batch, source)
        drain(stream_alerts(stream_table(spark, source, batch.schema)), out, checkpoint)
    rows = spark.read.parquet(out).orderBy("window_start").collect()
    assert [(r.window_start.day, r.transactions, r.total_amount, r.high_value_alerts, r.suspicious_alerts) for r in rows] == [
        (1, 2, 160000.0, 1, 1), (2, 1, 5.0, 0, 0), (3, 1, 7.0, 0, 0)]


def test_sliding_windows_are_sums_of_panes(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "customer_id long, ts timestamp, amount double"

    def at(hours):
        return EPOCH + datetime.timedelta(hours=hours)

    rows = [(i % 2, at(i * 0.75), float(i)) for i in range(96)]
    steps = [rows[:40], [*rows[40:], (1, at(0.5), 1e6)], [(7, at(400), 1.0)]]  # the second step has a row that is too late
    for step in steps:
        batch = spark.createDataFrame(step, schema)
        land(batch, source)
        drain(stream_alerts(stream_table(spark, source, batch.schema), "9 hours", "1 hour", "6 hours", high=50, suspicious=20), out, checkpoint)
    plan = stream_alerts(spark.createDataFrame(rows, schema), "9 hours", "1 hour", "6 hours")._jdf.queryExecution().toString()
    analyzed = plan.split("== Optimized")[1].split("== Physical")[0]
    assert analyzed.index("Expand") < analyzed.rindex("Aggregate")  # above the aggregate of the panes
    expected = {}
    for c, t, a in rows:
        hours = (t - EPOCH).total_seconds() / 3600
        for start in range(-12, 100, 6):
            if start <= hours < start + 9:
                n, total, high, odd = expected.get((c, start), (0, 0.0, 0, 0))
                expected[c, start] = (n + 1, total + a, high + (a >= 50), odd + (20 <= a < 50))
    got = {(r.customer_id, (r.window_start - EPOCH).total_seconds() / 3600): (r.transactions, r.total_amount, r.high_value_alerts, r.suspicious_alerts)
           for r in spark.read.parquet(out).where("customer_id < 7").collect()}
    assert got == expected


def test_stream_audit_masks_details(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    batch = spark.createDataFrame([(EPOCH, "a", "u", '{"mail": "john@bank.com"}')], "timestamp timestamp, action string, user_id string, details string")
    for _ in range(2):
        land(batch, source)
        stream_audit(stream_table(spark, source, batch.schema), out, checkpoint).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 2 and {r.details for r in rows} == {'{"mail": "jo*********om"}'}
    assert {r.status for r in rows} == {"success"} and {str(r.date) for r in rows} == {"2024-01-01"}


def test_registered_function(spark):
    @catalog_function(catalog="main", schema="s")
    def shout(word: str, times: int) -> str | None:
        """Say it."""
        return None if word is None else word.upper() * times

    assert shout.catalog_metadata == {"catalog": "main", "schema": "s", "function_name": "shout", "comment": "Say it.", "full_name": "main.s.shout"}
    register_function(spark, shout)
    assert spark.sql("SELECT shout('a', 3) AS s").first().s == "AAA"
    assert [sql_type(t).simpleString() for t in (str, int, float, bool, list, dict, bytes)] == [
        "string", "bigint", "double", "boolean", "array<string>", "map<string,string>", "string"]
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_many_keys_are_few_groups(spark, tmp_path, monkeypatch):
    """Keys share buckets: one group of Spark for each, one state for each key, in both orders of answers."""
    from clientlens.streaming import admission as stream_admission

    monkeypatch.setattr(stream_admission, "BUCKETS", 3)
    rows = [(i, f'u"{i * 7 % 60}', "a, b" if i % 3 else "a", EPOCH + datetime.timedelta(microseconds=i * 250_000 + i % 7)) for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, user_id string, action string, timestamp timestamp")
    last = spark.createDataFrame([(999, "end", "a", EPOCH + datetime.timedelta(hours=3))], events.schema)
    expected = admission.ttl_repeats(events, ["user_id", "action"], ttl=20)
    for answers in ("arrival", "time"):
        source, out, checkpoint = (str(tmp_path / answers / n) for n in ("in", "out", "check"))
        sizes = []
        for batch in (events.limit(250), events.exceptAll(events.limit(250)), last):
            land(batch, source)
            drain(stream_ttl_repeats(stream_table(spark, source, events.schema), ["user_id", "action"], ttl=20, answers=answers), out, checkpoint)
            store = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "state").load()
            sizes.append((store.count(), store.select("key").distinct().count()))
        got = spark.read.parquet(out).where("event_id <> 999").select(expected.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
        if answers == "arrival":
            assert sizes[1][0] > 50 and sizes[1][1] <= 3
            assert sizes[2] == (1, 1)
