import duckdb

from clientlens.llm import rules
from clientlens.llm.common import documents
from clientlens.llm.queries import ORACLES, op4
from tests.llm.odd import no_documents, odd_documents, words


def measured(text):
    text = text or ""
    w = words(text)
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [line for line in text.split("\n") if words(line)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    cursor = con.execute(ORACLES["op4_rules"])
    df = op4(spark, sf_dir)
    assert df.columns == [c[0] for c in cursor.description]
    assert sorted(map(tuple, df.collect())) == sorted(cursor.fetchall())


def test_native_plan_without_shuffle(spark, sf_dir):
    plan = rules.ledger(documents(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))


def test_measurements_by_brute_force(spark):
    texts = ["a b c d e f g h " * 3, "x " * 40, "one two three four five six seven eight nine ten one two three four five six seven eight",
             "l\nl\n\nl\n m\nm", "a # b | c & d <e>", "w " * 8, "w " * 9, "é! " * 30]
    docs, rows = odd_documents(spark, texts)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in rules.ledger(docs).collect():
        assert tuple(r[n] for n in names) == measured(rows[r.doc_id][1])


def test_odd_rows(spark):
    docs, rows = odd_documents(spark)
    found = rules.ledger(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(tuple(r[n] for n in names) for r in found) == sorted(measured(t) for _, t in rows)
    assert all(r.failed & 1 for r in found if r.n_words < 20)
    assert rules.ledger(no_documents(spark)).count() == 0


def test_policies_and_ablations_need_only_the_ledger(spark):
    entries = spark.createDataFrame([(1, 0), (2, 0b1), (3, 0b11), (4, 0b10), (5, 0b10), (6, 0b100)], "doc_id long, failed long")
    kept = {r.doc_id for r in entries.where(rules.passes(rules.POLICIES["v1"])).collect()}
    assert kept == {1, 6}
    found = {r.rule: (r.n_failed, r.n_only) for r in rules.ablations(entries, ("few_words", "repeated_words")).collect()}
    assert found == {"few_words": (2, 1), "repeated_words": (3, 2)}
