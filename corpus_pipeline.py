"""Documents to training sequences: five stages, each an operator of ``clientlens.llm``.

Every stage works on all rows its predecessor kept. All but the last return the
columns of ``documents``; the last returns pieces of token sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.llm import language, packing, private, quality, similarity
from clientlens.llm.common import crc_remainder, documents, written

# A document whose pooled language probability is lower is rejected: with four languages, no better than a guess.
LEAST_LANGUAGE_SCORE = 0.4
SMALL = 1_000_000  # rows of a table of ids that may be broadcast


def _fold(modulus: int, held_out: int):
    """Rows that may be learned from, as the single queries have it."""
    return F.coalesce(crc_remainder("doc_id", modulus) != held_out, F.lit(True))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null and empty texts are scored like others, repeated
    rows alike; columns of any name are handed through; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(quality.statistics(docs.where(_fold(4, 2))), labels)
    return docs.where(quality.score_text(model) >= quality.THRESHOLD)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network recognises; null texts, those without a letter and mere guesses go.
    Repeated rows fare alike; columns of any name but lang_pred and lang_score, which the operator adds, are handed through."""
    network = language.fit(docs.where(_fold(3, 1)))
    if network is None:  # no row says what a language is
        return docs
    named = language.identify(docs, network)
    return named.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; of repeated rows with an id, one.

    Rows without an id can't be grouped and stay.
    """
    groups = similarity.similar_documents(docs).where("doc_id IS NOT NULL")
    said = written(groups.groupBy("doc_id").agg(F.min("component_id").alias("first"), F.count(F.lit(1)).alias("n"))
                   .where("first <> doc_id OR n > 1").select("doc_id", (F.col("first") == F.col("doc_id")).alias("stays")), "said")
    said = F.broadcast(said) if said.count() <= SMALL else said
    single = docs.join(said, "doc_id", "left_anti")
    repeated = docs.join(said.where("stays"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return single.select(docs.columns).unionByName(repeated.select(docs.columns))


def without_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; n_chars follows the new text. Null and empty texts stay as they are."""
    hidden = docs.withColumn("text", private.redact_text(private.fit(docs)))
    if "n_chars" in docs.columns:
        hidden = hidden.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return hidden.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of all documents; a null or empty text is its end id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("language", keep_known_language),
    ("near_duplicates", one_of_similar),
    ("private", without_private),
    ("packing", packed),
]

# Trained models and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each result is written and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
