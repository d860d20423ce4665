"""The stored inverted index against search over the texts, its bounds, and what a query reads."""

import random

import pytest
from pyspark.sql import functions as F

from clientlens.operators import search, text_index


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(["The"] * (i % 3 == 0) + rng.choices(vocabulary, [1 / (j + 1) for j in range(300)], k=rng.randint(1, 60)) * rng.choice([1, 1, 3])))
            for i in range(900)]
    rows += [(900, None), (901, ""), (902, " \n "), (903, "w250 " * 5000), (904, "w7 w7"), (905, "W7 w7"), (906, "a\tb c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path_factory.mktemp("index"))
    for part in range(3):
        text_index.add_documents(df.where(F.col("doc_id") % 3 == part), path)
    return df, path


@pytest.mark.parametrize("query, k", [("w7", 1), ("w7", 5), ("the w0 w250", 10), ("w299 w298 nowhere", 7), ("the", 3), ("nowhere", 5), ("W3 w12 w40 w90", 150),
                                      ("a b c", 2)])
def test_same_rows_as_search_over_texts(spark, built, query, k):
    df, path = built
    expected = search.text_search(df, query, k).collect()
    assert text_index.index_search(spark, path, query, k).collect() == expected
    every = {r.doc_id: r.relevance_score for r in search.text_scores(df, query).collect()}
    got = text_index.index_scores(spark, path, query).collect()
    assert {r.doc_id: r.relevance_score for r in got} == every and len(got) == len(every)


def test_bounds_leave_documents_out(spark, built):
    _, path = built
    lookup = text_index.Lookup(spark, path, "w5 w150")
    some = text_index.candidates(lookup, 3).count()
    every = lookup.table("postings").select("doc").distinct().count()
    assert 3 <= some < every / 2
    assert text_index.candidates(lookup, text_index.TOP_KEPT + 1) is None


def test_a_query_reads_its_terms_alone(spark, built):
    _, path = built
    query = text_index.Lookup(spark, path, "w5 w150").table("postings")._jdf.queryExecution()
    plan = spark._jvm.PythonSQLUtils.explainString(query, "formatted")
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("\n")[0]
    assert "In(term" in plan.split("PushedFilters: [")[1].split("\n")[0]
    files = text_index.Lookup(spark, path, "w5").table("postings").select(F.input_file_name()).distinct().count()
    assert files <= 6  # of one bucket in each of three batches


def test_a_batch_without_size_does_not_count(spark, built, tmp_path):
    df, _ = built
    path = str(tmp_path / "index")
    text_index.add_documents(df.where("doc_id < 100"), path)
    before = text_index.index_scores(spark, path, "w1").count()
    broken = df.where("doc_id BETWEEN 100 AND 200")
    text_index.add_documents(broken, path)
    import pathlib
    import shutil

    batches = {p.name for p in pathlib.Path(path, "size").iterdir()}
    newest = max(batches, key=lambda b: pathlib.Path(path, "size", b).stat().st_mtime)
    shutil.move(str(pathlib.Path(path, "size", newest)), str(tmp_path / "unfinished"))
    assert text_index.index_scores(spark, path, "w1").count() == before


def test_empty_query_and_table(spark, tmp_path):
    path = str(tmp_path / "index")
    text_index.add_documents(spark.createDataFrame([], "doc_id long, text string"), path)
    text_index.add_documents(spark.createDataFrame([(1, "word"), (2, "other")], "doc_id long, text string"), path)
    assert [tuple(r) for r in text_index.index_search(spark, path, "word").collect()] == [(1, 1.0)]
    with pytest.raises(ValueError):
        text_index.index_search(spark, path, "  ")


def test_texts_are_counted_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text_of(number):
        read.add(1)
        return f"word and w{number % 7}"

    docs = spark.range(50).select(F.col("id").alias("doc_id"), text_of(F.col("id")).alias("text"))
    text_index.add_documents(docs, str(tmp_path / "index"))
    assert read.value == 50
    assert text_index.index_scores(spark, str(tmp_path / "index"), "w3 word").count() == 50
