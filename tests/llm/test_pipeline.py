import corpus_pipeline as pipeline
from clientlens.llm import private, quality
from clientlens.llm.common import documents
from tests.llm.odd import no_documents, odd_documents
from tests.llm.test_similarity import by_brute_force


def test_stages_on_the_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    before = {r.doc_id: r for r in docs.collect()}
    kept, texts = [], []
    current = docs
    for name, stage in pipeline.STAGES[:-1]:
        current = stage(spark, current, sf_dir).cache()
        assert current.columns == docs.columns and current.dtypes == docs.dtypes
        rows = {r.doc_id: r for r in current.collect()}
        kept.append(set(rows))
        texts.append(rows)
    good, known, single, hidden = kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert sum((d in good) == (q == 1) for d, q in labels.items()) >= 0.97 * len(labels)
    assert known <= good and len(known) >= 0.98 * len(good)
    expected = by_brute_force([(d, before[d].text) for d in known])
    assert single == {d for d, (_, root) in expected.items() if d == root}
    assert hidden == single
    for d in hidden:
        after = texts[-1][d]
        assert not private.base_spans(after.text) and after.n_chars == len(after.text)
        assert (after.text == before[d].text) or "<" in after.text
    pieces = pipeline.STAGES[-1][1](spark, current, sf_dir).collect()
    assert {p.doc_id for p in pieces} == hidden
    assert [name for name, _ in pipeline.STAGES] == ["quality", "language", "near_duplicates", "private", "packing"]


def test_run(spark, sf_dir):
    assert pipeline.run(spark, sf_dir).count() > 0


def test_stages_on_odd_and_empty_tables(spark, sf_dir):
    docs, rows = odd_documents(spark)
    for name, stage in pipeline.STAGES:
        for table in (docs, no_documents(spark)):
            found = stage(spark, table, sf_dir)
            n = found.count()
            if name != "packing":
                assert found.columns == table.columns
            if name == "private":
                assert n == table.count()
            if name == "near_duplicates" and table is docs:
                # 6, its repeated rows and 7 are one; 4 and the like stay; rows without an id stay
                assert n == len(rows) - 3
            if table is not docs:
                assert n == 0
    assert quality.THRESHOLD > pipeline.LEAST_LANGUAGE_SCORE
