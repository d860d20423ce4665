"""Largest inner products by multiprobe p-stable hashing.

Vectors are lifted by one coordinate to equal length, so that a larger inner
product is a smaller distance. Each table hashes a lifted vector by several
Gaussian projections, shifted and cut into cells; the cells' numbers are its
bucket. For a query every occupied bucket is a perturbation of its own; under
the Gaussian projections the chance that a near vector fell into a bucket drops
with the squared distance between the query's projections and the bucket's
centre, so buckets are visited in that order until a share of them is seen. The
tables' candidates are merged and ranked by exact inner products.

Index and queries are dealt into blocks by a hash of the id and meet block by
block; only the best of each block travel on. No block depends on how often a
vector occurs: copies are one vector with a list of ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientlens.llm.common import arrow_schema

TABLES = 2
HASHES = 24
CELL = 1.6  # width of a cell, in standard deviations of a projection
PROBES = 0.4  # share of a table's occupied buckets that a query visits
INDEX_BLOCK, QUERY_BLOCK = 4096, 512


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a finite vector that is not zero, as doubles."""
    v = F.col("embedding").cast("array<double>")
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", v.alias("v")).where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))


def usual_length(vectors: DataFrame) -> int:
    """The most frequent length of ``usable`` vectors, the smallest of several; 0 if there are none."""
    length = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return length["d"] if length else 0


def _best(index_ids: np.ndarray, index: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, norm: float,
          k: int, probes: float, tables: int, hashes: int, seed: int = 5) -> list[list]:
    """[query ids, vector ids, scores] of the k best candidates of each query among one block."""
    unique, of = np.unique(index, axis=0, return_inverse=True)
    order = np.lexsort((index_ids, of.ravel()))
    grouped = np.split(index_ids[order], np.cumsum(np.bincount(of.ravel(), minlength=len(unique)))[:-1])
    d = index.shape[1]
    lifted = np.hstack([unique, np.sqrt(np.maximum(0, norm ** 2 - (unique ** 2).sum(1)))[:, None]])
    asked = np.hstack([queries * (norm / np.linalg.norm(queries, axis=1))[:, None], np.zeros((len(queries), 1))])
    rng = np.random.default_rng(seed)
    candidate = np.zeros((len(queries), len(unique)), bool)
    width = CELL * norm / np.sqrt(d + 1)
    for _ in range(tables):
        gaussian = rng.standard_normal((d + 1, min(hashes, d + 1)))
        directions = np.linalg.qr(gaussian)[0]  # Gaussian directions, made orthogonal
        shift = rng.uniform(0, 1, directions.shape[1])
        cells = np.floor(lifted @ directions / width + shift)
        buckets, bucket = np.unique(cells, axis=0, return_inverse=True)
        place = asked @ directions / width + shift
        centre = buckets + 0.5
        gap = (centre ** 2).sum(1)[None, :] - 2 * place @ centre.T  # squared distance but for the query's own part
        visited = max(k + 1, int(np.ceil(probes * len(buckets))))
        seen = np.ones(gap.shape, bool)
        if visited < len(buckets):
            limit = np.partition(gap, visited - 1, axis=1)[:, visited - 1:visited]
            seen = gap <= limit
        candidate |= seen[:, bucket.ravel()]
    out: list[list] = [[], [], []]
    for row, own in enumerate(query_ids):
        columns = np.flatnonzero(candidate[row])
        if len(columns) > k + 1:  # one may be the query itself; all that may equal the last one kept are ranked by id
            product = unique[columns] @ queries[row]
            last = np.partition(product, len(product) - k - 1)[len(product) - k - 1]
            columns = columns[product >= last - 1e-12 * d * norm * np.linalg.norm(queries[row])]
        exact = (unique[columns] * queries[row]).sum(axis=1)  # the same order of adding up for every vector
        found = [(-s, int(i), s) for s, c in zip(exact.tolist(), columns, strict=True) for i in grouped[c][:k + 1] if i != own]
        found.sort()
        for _, i, s in found[:k]:
            out[0].append(int(own))
            out[1].append(i)
            out[2].append(s)
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, probes: float = PROBES, tables: int = TABLES,
            hashes: int = HASHES) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k largest inner products found among ``vectors``.

    Both tables have vec_id and embedding. A query never finds its own id. Null
    ids and vectors, zero vectors, and those with a null, NaN or infinite
    component take no part, nor do vectors and queries of another length than
    most of ``vectors`` have. Equal
    scores rank by id. Copies all count; a repeated id is found once. With no
    usable vectors there are no rows. Other columns are not read.
    """
    index, asked = usable(vectors), usable(queries)
    length = usual_length(index)
    index, asked = (side.where(F.size("v") == length) for side in (index, asked))
    size, norm = index.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate(
        "v", F.lit(0.0), lambda total, x: total + x * x)))).first()
    blocks = max(1, -(-size // INDEX_BLOCK))
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = index.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
                        every(query_blocks).alias("query_block"))
    right = asked.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("query_block"),
                         every(blocks).alias("block"))
    schema = "query_id long, vec_id long, score double"
    target = arrow_schema(vectors.sparkSession, schema)

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = table.column("v").combine_chunks()
        return table.column("vec_id").to_numpy(), flat.flatten().to_numpy().reshape(len(flat), -1)

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not len(mine) or not len(theirs):
            return target.empty_table()
        found = _best(*matrix(mine), *matrix(theirs), norm, k, probes, tables, hashes)
        return pa.table([pa.array(c, f.type) for c, f in zip(found, target, strict=True)], schema=target)

    keys = ("block", "query_block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
