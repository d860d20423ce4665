"""Vector, hybrid and text search, and matching against a store of past queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.common import round_half_up, top_n_per
from clientlens.functions.keys import text_hash
from clientlens.functions.text import words
from clientlens.operators.products import DEFAULT_RESULTS, ranked_results
from clientlens.session import scratch_path

# Search and store thresholds.
SCORE_THRESHOLD = 0.7
MATCH_THRESHOLD = 0.95

# Vectors of a block, and how many of them are scored at once.
BLOCK_VECTORS = 16_384
CHUNK_VECTORS = 4096
SCORE_DIGITS = 6


def _matrix(column) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision.

    Shorter vectors are padded with zeros, which leaves dot products over the
    shorter length and norms unchanged; a vector without length stays zero.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    flat = np.nan_to_num(np.asarray(column.flatten(), dtype=np.float64))
    width = int(sizes.max()) if len(sizes) else 0
    if len(sizes) and (sizes == width).all():
        matrix = flat.reshape(len(sizes), width)
    else:
        matrix = np.zeros((len(sizes), width))
        matrix[np.arange(width) < sizes[:, None]] = flat
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    width = min(queries.shape[1], vectors.shape[1])
    return queries[:, :width] @ vectors[:, :width].T


def _best(query_ids, vector_ids, scores, k, threshold):
    """At most ``k`` pairs per query from one score block, best first, ids breaking ties."""
    rows = []
    for i in range(scores.shape[0]):
        keep = np.flatnonzero(scores[i] >= threshold)
        if len(keep):
            shown = np.round(scores[i][keep], SCORE_DIGITS)
            order = np.lexsort((vector_ids[keep], -shown))[:k]
            rows.append((np.full(len(order), query_ids[i]), vector_ids[keep][order], shown[order]))
    return rows


def _first(query_ids, vector_ids, scores, k, threshold):
    """The lowest vector id at or above the threshold per query."""
    hit = scores >= threshold
    found = np.flatnonzero(hit.any(axis=1))
    if not len(found):
        return []
    lowest = np.where(hit[found], vector_ids, np.iinfo(np.int64).max).argmin(axis=1)
    return [(query_ids[found], vector_ids[lowest], np.round(scores[found, lowest], SCORE_DIGITS))]


_PAIR_SCHEMA = "query_id long, vector_id long, score double"


def _pair_batch(rows) -> pa.RecordBatch:
    parts = [np.concatenate(c) for c in zip(*rows)] if rows else [np.array([], dtype=t) for t in ("i8", "i8", "f8")]
    return pa.RecordBatch.from_arrays([pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.int64()),
                                       pa.array(parts[2], pa.float64())], names=["query_id", "vector_id", "score"])


def _pairs(small: DataFrame, large: DataFrame, small_is_query: bool, pick, k: int, threshold: float) -> DataFrame:
    """Score pairs chosen by ``pick``; both inputs are (id, embedding).

    Both sides are dealt into blocks by a hash of the id and meet block by
    block, whatever their sizes: with up to BLOCK_VECTORS queries no vector is
    copied. Each meeting sends on at most ``k`` pairs per query.
    """
    small_blocks = max(1, -(-small.count() // BLOCK_VECTORS))
    large_blocks = max(1, -(-large.count() // BLOCK_VECTORS))

    def cut(df: DataFrame, mine: str, mine_blocks: int, other: str, other_blocks: int) -> DataFrame:
        return (df.withColumn(mine, F.pmod(F.xxhash64("id"), F.lit(mine_blocks)))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_blocks - 1).cast("long")))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([_pair_batch([])])
        queries, vectors = (left, right) if small_is_query else (right, left)
        query_ids = np.asarray(queries.column("id"), dtype=np.int64)
        vector_ids = np.asarray(vectors.column("id"), dtype=np.int64)
        query_units, vector_units = _matrix(queries.column("embedding")), _matrix(vectors.column("embedding"))
        out = []
        for start in range(0, len(vector_ids), CHUNK_VECTORS):
            part = slice(start, start + CHUNK_VECTORS)
            out.append(_pair_batch(pick(query_ids, vector_ids[part], _scores(query_units, vector_units[part]), k, threshold)))
        return pa.Table.from_batches(out)

    left = cut(small, "_s", small_blocks, "_l", large_blocks).groupBy("_s", "_l")
    right = cut(large, "_l", large_blocks, "_s", small_blocks).select("id", "embedding", "_s", "_l").groupBy("_s", "_l")
    return left.cogroup(right).applyInArrow(meet, _PAIR_SCHEMA)


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = DEFAULT_RESULTS,
                  threshold: float = SCORE_THRESHOLD, query_id: str = "query_id", vector_id: str = "vec_id",
                  embedding: str = "embedding") -> DataFrame:
    """The ``k`` nearest vectors by cosine per query: query_id, vector_id, score, rank.

    Exact. Each task scores its vectors against the queries as one matrix
    product and passes on at most ``k`` pairs per query and batch.
    """
    found = _pairs(queries.select(F.col(query_id).cast("long").alias("id"), F.col(embedding).alias("embedding")),
                   vectors.select(F.col(vector_id).cast("long").alias("id"), F.col(embedding).alias("embedding")),
                   True, _best, k, threshold)
    return top_n_per(found, ["query_id"], [F.desc("score"), F.asc("vector_id")], k)


def hybrid_search(queries: DataFrame, vectors: DataFrame, table: DataFrame, keyword: str | None,
                  k: int = DEFAULT_RESULTS, threshold: float = SCORE_THRESHOLD,
                  vector_id: str = "vec_id", table_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Vector search over the rows whose text holds the keyword, with the text as content."""
    rows = table.select(F.col(table_id).alias("_id"), F.col(text).alias("content"))
    if keyword:
        rows = rows.where(F.contains(F.lower("content"), F.lit(keyword.lower())))
    kept = vectors.join(rows.select("_id"), vectors[vector_id] == F.col("_id"), "left_semi")
    found = vector_search(queries, kept, k, threshold, vector_id=vector_id)
    return (found.join(rows, found["vector_id"] == rows["_id"])
            .select("query_id", "vector_id", "content", F.col("score").alias("vector_score"),
                    F.lit(bool(keyword)).alias("keyword_match"), "rank"))


def _equals(term: str):
    return lambda word: word == term


def text_scores(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, relevance_score) for documents sharing a word with the query.

    Published lnc.ltc weighting: documents by 1 + ln tf, the query by idf, both
    cosine-normalised. Term counts, norms and matches are found inside each row;
    the document frequencies of the query's words come from one aggregate.
    """
    terms = sorted(set(query.lower().split()))
    if not terms:
        raise ValueError("empty query")
    tokens = docs.select(key, words(F.lower(text)).alias("_words"))
    frequency = tokens.agg(F.count("*").alias("n"), *[
        F.count_if(F.array_contains("_words", t)).alias(f"df{i}") for i, t in enumerate(terms)])
    weights = frequency.select(F.array(*[
        F.when(F.col(f"df{i}") > 0, F.ln(F.col("n") / F.col(f"df{i}"))).otherwise(0.0) for i in range(len(terms))])
        .alias("w")).scalar()

    # Squared weights by run lengths over the sorted words: one pass, no shuffle.
    start = F.struct(F.lit("").alias("word"), F.lit(0).cast("long").alias("run"), F.lit(0.0).alias("total"))

    def weight(run):
        return F.pow(1 + F.ln(run.cast("double")), F.lit(2.0))

    def step(state, word):
        same = state["word"] == word
        return F.struct(
            word.alias("word"), F.when(same, state["run"] + 1).otherwise(F.lit(1).cast("long")).alias("run"),
            F.when(same | (state["run"] == 0), state["total"]).otherwise(state["total"] + weight(state["run"])).alias("total"))

    squares = F.aggregate(F.sort_array("_words"), start, step, lambda s: s["total"] + weight(F.greatest(s["run"], F.lit(1))))
    hits = tokens.where(F.arrays_overlap("_words", F.array(*[F.lit(t) for t in terms])))
    counts = F.array(*[F.size(F.filter("_words", _equals(t))) for t in terms])
    product = F.aggregate(
        F.zip_with(counts, F.col("_weights"), lambda c, w: F.when(c > 0, (1 + F.ln(c.cast("double"))) * w).otherwise(0.0)),
        F.lit(0.0), lambda a, x: a + x)
    query_norm = F.sqrt(F.aggregate("_weights", F.lit(0.0), lambda a, w: a + w * w))
    score = F.coalesce(F.try_divide(product, query_norm * F.sqrt(squares)), F.lit(0.0))
    return (hits.withColumn("_weights", weights)
            .select(key, round_half_up(score, SCORE_DIGITS).alias("relevance_score")))


def text_search(docs: DataFrame, query: str, k: int = DEFAULT_RESULTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ``k`` most relevant documents."""
    return text_scores(docs, query, key, text).orderBy(F.desc("relevance_score"), F.asc(key)).limit(k)


def search_documents(docs: DataFrame, scores: DataFrame, document_type: str | None = None,
                     num_results: int = DEFAULT_RESULTS) -> DataFrame:
    """Scored documents of one type, with the number found before the limit."""
    if document_type:
        docs = docs.where(F.col("document_type") == document_type)
    return ranked_results(docs.join(scores, "doc_id"), "relevance_score", "doc_id", num_results)


def _kept(df: DataFrame, label: str) -> DataFrame:
    """Rows that several steps read, written to the shared folder once."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def semantic_match(queries: DataFrame, store: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Stored response per query: same text first, else the first entry close enough.

    ``queries``: query_id, text, embedding (null when unknown). ``store``:
    insert_seq, text, embedding, response. "First" is by insertion, not nearness.
    A text stored again keeps its place and takes the later response. Texts are
    read once and go on as their hashes.
    """
    entries = _kept(store.withColumn("_hash", text_hash(F.col("text"))).groupBy("_hash").agg(
        F.min("insert_seq").alias("insert_seq"), F.max_by("response", "insert_seq").alias("response"),
        F.max_by("embedding", "insert_seq").alias("embedding")), "entries")
    asked = _kept(queries.select("query_id", text_hash(F.col("text")).alias("_hash"), "embedding"), "asked")
    exact = (asked.select("query_id", "_hash").join(entries.select("_hash", "insert_seq", "response"), "_hash")
             .select("query_id", "insert_seq", "response", F.lit("exact").alias("match_type"), F.lit(1.0).alias("score")))
    rest = asked.join(entries.select("_hash"), "_hash", "left_anti").where(F.col("embedding").isNotNull())
    close = _pairs(entries.where(F.col("embedding").isNotNull())
                   .select(F.col("insert_seq").cast("long").alias("id"), "embedding"),
                   rest.select(F.col("query_id").cast("long").alias("id"), "embedding"),
                   False, _first, 1, threshold)
    first = close.groupBy("query_id").agg(F.min("vector_id").alias("insert_seq"), F.min_by("score", "vector_id").alias("score"))
    near = (first.join(entries.select("insert_seq", "response"), "insert_seq")
            .select("query_id", "insert_seq", "response", F.lit("semantic").alias("match_type"), "score"))
    matched = exact.unionByName(near)
    return (asked.select("query_id").join(matched, "query_id", "left")
            .withColumn("match_type", F.coalesce("match_type", F.lit("none"))))
