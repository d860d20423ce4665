"""Text search over a stored inverted index.

The index is a folder of Parquet tables, built once and appended to:

* ``postings`` (doc, term, weight), in folders by batch and by a hash of the term,
  ordered by term and falling weight. Weights are 1 + ln tf over the document's
  norm, so that a query needs no other text of the document;
* ``terms`` (term, df), ``tops`` (the TOP_KEPT largest weights of each term) and
  ``size`` (documents). A batch counts from the moment its ``size`` is there.

A query reads the folders of its terms only, and within them the row groups of
the terms. For the ``k`` best documents the largest weights give a bound: some
term alone lifts k documents to it. A document of m query terms that reaches the
bound has a term that brings an m-th of it, so only postings of at least that
weight are read to find candidates. Scores are those of
:func:`clientlens.operators.search.text_scores`.
"""

from __future__ import annotations

import math
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.common import let, round_half_up, top_n_per
from clientlens.functions.text import words
from clientlens.operators.products import DEFAULT_RESULTS
from clientlens.operators.search import SCORE_DIGITS

BUCKETS = 64
TOP_KEPT = 100
# Ranks go by rounded scores, ties by document: a candidate may be short of the bound by the rounding.
_ROUNDING = 10.0 ** -SCORE_DIGITS


def _term_counts(text: Column) -> Column:
    """(term, tf) of a text's words, from the runs of the sorted words."""
    def runs(ordered: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        counted = let(starts, lambda s: F.transform(s, lambda at, j: F.struct(
            F.get(ordered, at).alias("term"), (F.coalesce(F.get(s, j + 1), F.size(ordered)) - at).alias("tf"))))
        return F.when(F.size(ordered) > 0, counted)

    return let(F.sort_array(words(F.lower(text))), runs)


def _weight(tf: Column) -> Column:
    return 1 + F.ln(tf.cast("double"))


def add_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Add documents to the index at ``path``, which need not exist; their keys must be new.

    Null texts and those without a word count as documents and are never found.
    Postings are dealt by bucket, and AQE cuts buckets of more than its advisory
    size, so a word that most documents share is spread over many tasks. Ranges
    would do the same, but sampling them counts the terms of all texts twice.
    """
    spark, batch = docs.sparkSession, uuid.uuid4().hex

    def at(table: str) -> str:
        return f"{path}/{table}/batch={batch}"

    counted = docs.select(F.col(key).alias("doc"), _term_counts(F.col(text)).alias("terms"))
    norm = F.sqrt(F.aggregate("terms", F.lit(0.0), lambda total, t: total + F.pow(_weight(t["tf"]), F.lit(2.0))))
    # A plain explode would also filter on the number of terms, and so count every text once more.
    rows = counted.withColumn("norm", norm).select("doc", "norm", F.explode_outer("terms").alias("t")).where(F.col("t").isNotNull())
    rows = rows.select("doc", F.col("t.term").alias("term"), (_weight(F.col("t.tf")) / F.col("norm")).alias("weight"),
                       F.pmod(F.crc32(F.col("t.term").cast("binary")), F.lit(BUCKETS)).cast("int").alias("bucket"))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", F.desc("weight")).write.partitionBy("bucket").parquet(at("postings"))
    stored = spark.read.schema("doc string, term string, weight double, bucket int").parquet(at("postings")).drop("doc")
    stored.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")).repartition("bucket") \
        .sortWithinPartitions("term").write.partitionBy("bucket").parquet(at("terms"))
    top_n_per(stored, ["bucket", "term"], [F.desc("weight")], TOP_KEPT).select("bucket", "term", "weight").repartition("bucket") \
        .sortWithinPartitions("term").write.partitionBy("bucket").parquet(at("tops"))
    docs.agg(F.count(F.lit(1)).alias("n")).write.parquet(at("size"))


class Lookup:
    """What the small tables say about a query: idf of its terms, and the postings to read."""

    def __init__(self, spark: SparkSession, path: str, query: str):
        self.spark, self.path = spark, path
        self.terms = sorted(set(query.lower().split()))
        if not self.terms:
            raise ValueError("empty query")
        self.buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in self.terms})
        sizes = spark.read.option("basePath", f"{path}/size").parquet(f"{path}/size").select("batch", "n").collect()
        self.batches, n = [r["batch"] for r in sizes], sum(r["n"] for r in sizes)
        found = {r["term"]: r["df"] for r in self.table("terms").groupBy("term").agg(F.sum("df").alias("df")).collect()}
        self.idf = {t: math.log(n / found[t]) for t in self.terms if t in found}
        self.norm = math.sqrt(sum(w * w for w in self.idf.values()))

    def table(self, name: str) -> DataFrame:
        """The rows of the query's terms: pruned by batch and bucket, and pushed down by term."""
        rows = self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        return rows.where(F.col("batch").isin(self.batches) & F.col("bucket").isin(self.buckets) & F.col("term").isin(self.terms))

    def scores(self, postings: DataFrame) -> DataFrame:
        share = F.lit(0.0)
        for term, weight in self.idf.items():
            share = F.when(F.col("term") == term, F.lit(weight / self.norm if self.norm else 0.0)).otherwise(share)
        return postings.groupBy("doc").agg(F.sum(F.col("weight") * share).alias("score"))

    def bound(self, k: int) -> float:
        """A score that at least ``k`` documents reach, 0 if none is known."""
        if k > TOP_KEPT or not self.norm:
            return 0.0
        best: dict[str, list[float]] = {}
        for r in self.table("tops").select("term", "weight").collect():  # at most TOP_KEPT rows a term and batch
            best.setdefault(r["term"], []).append(r["weight"])
        reached = [sorted(w, reverse=True)[k - 1] * self.idf[t] / self.norm for t, w in best.items() if len(w) >= k]
        return max(reached, default=0.0)


def index_scores(spark: SparkSession, path: str, query: str, key: str = "doc_id") -> DataFrame:
    """(key, relevance_score) for all documents sharing a word with the query."""
    lookup = Lookup(spark, path, query)
    return lookup.scores(lookup.table("postings")).select(
        F.col("doc").alias(key), round_half_up(F.col("score"), SCORE_DIGITS).alias("relevance_score"))


def candidates(lookup: Lookup, k: int) -> DataFrame | None:
    """Documents that may be among the ``k`` best, or None if no bound is known."""
    bound = lookup.bound(k) - _ROUNDING
    if bound <= 0:
        return None
    heavy = F.lit(False)
    for term, idf in lookup.idf.items():
        if idf > 0:
            least = bound * lookup.norm / idf / len(lookup.idf) * (1 - 1e-9)
            heavy = heavy | ((F.col("term") == term) & (F.col("weight") >= least))
    return lookup.table("postings").where(heavy).select("doc").distinct()


def index_search(spark: SparkSession, path: str, query: str, k: int = DEFAULT_RESULTS, key: str = "doc_id") -> DataFrame:
    """The ``k`` most relevant documents, as :func:`clientlens.operators.search.text_search` finds them."""
    lookup = Lookup(spark, path, query)
    postings, promising = lookup.table("postings"), candidates(lookup, k)
    if promising is not None:
        postings = postings.join(promising, "doc", "left_semi")
    scored = lookup.scores(postings).select(F.col("doc").alias(key),
                                            round_half_up(F.col("score"), SCORE_DIGITS).alias("relevance_score"))
    return scored.orderBy(F.desc("relevance_score"), F.asc(key)).limit(k)
