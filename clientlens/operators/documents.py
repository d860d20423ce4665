"""Comparing documents by their words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.functions.text import compare_sets, similarity_columns, word_set


def pair_words(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_a, doc_b, words_a, words_b) for id pairs whose documents both exist.

    Texts are reduced to their distinct words before they are shuffled.
    """
    sets = documents.select("doc_id", word_set(F.coalesce("text", F.lit(""))).alias("_words"))
    a = sets.select(F.col("doc_id").alias("doc_a"), F.col("_words").alias("words_a"))
    b = sets.select(F.col("doc_id").alias("doc_b"), F.col("_words").alias("words_b"))
    return pairs.select("doc_a", "doc_b").join(a, "doc_a").join(b, "doc_b")


def word_set_operations(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """Common and unshared words of each pair."""
    return compare_sets(pair_words(pairs, documents), "words_a", "words_b")


def compare_documents(pairs: DataFrame, documents: DataFrame, comparison_type: str = "semantic") -> DataFrame:
    """Jaccard similarity of the word sets of each pair: the sets' sizes and that of their intersection say it all."""
    counted = pair_words(pairs, documents).select("doc_a", "doc_b", F.size("words_a").alias("_a"), F.size("words_b").alias("_b"),
                                                  F.size(F.array_intersect("words_a", "words_b")).alias("_both"))
    both = F.col("_both")
    compared = similarity_columns(counted, comparison_type, both, F.col("_a") - both, F.col("_b") - both)
    return compared.select("doc_a", "doc_b", "similarity_score", "common_terms_count", "unique_to_a", "unique_to_b",
                           "comparison_type", "summary")
