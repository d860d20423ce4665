"""Hard negatives by threshold joins over an inverted index with norm bounds.

A threshold join finds all rows whose inner product with an anchor reaches the
anchor's threshold. Anchors and rows are dealt into blocks; where two blocks
meet, the rows' dimensions are brought in order of rising energy and

1. the index leaves out the leading dimensions of a row as long as their norm,
   times the longest anchor's norm over the same dimensions, stays below the
   lowest threshold: no anchor can reach it by these dimensions alone;
2. partial scores are added up over the indexed entries, from the dimensions of
   most energy down; after each step a pair is given up if its partial score and
   the product of both remaining norms stay below the threshold;
3. for the pairs left, the dimensions outside the index complete the score.

Thresholds start high and are lowered for the anchors whose windows are not full:
first until each has its positives, then until each (anchor, positive) has its
negatives or the window's lower end is reached. The last round takes all rows,
so results are exact. A block passes on at most the wanted rows of each window.

Scores are inner products of floor(256 * x), whole numbers. They are computed in
double precision while that is exact (products of norms below 2**53), else with
whole numbers of any size; scores outside a long are cut to its range.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens.common import top_n_per
from clientlens.llm.common import written

SCALE = 256
# Rows and anchors of a block.
BLOCK_ROWS, BLOCK_ANCHORS = 4096, 512
# Dimensions that are added up between two tests of the bounds.
STEP = 8
# Rows that are compared with a block's anchors at once: their partial scores stay in the processor's cache.
TILE_ROWS = 256
# Thresholds of the rounds: shares of the greatest possible score, and of a window's upper end.
POSITIVE_SHARES = (0.6, 0.4, 0.25, 0.0)
NEGATIVE_SHARES = (0.85, 0.7)
_EXACT = float(1 << 53)
_LONGEST = (1 << 63) - 1
# Norms are rounded; bounds are widened by more than that.
_MARGIN = 1 + 1e-9


def quantised(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """floor(256 * x) of list rows, filled up with zeros."""
    flat = column.combine_chunks()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    sizes = np.asarray(flat.value_lengths(), np.int64)
    matrix = np.zeros((len(sizes), width))
    with np.errstate(over="ignore"):
        matrix[np.arange(width) < sizes[:, None]] = np.floor(SCALE * np.asarray(flat.flatten(), np.float64))
    return matrix


def _prefix_norms(matrix: np.ndarray) -> np.ndarray:
    """norms[:, k]: the norm of the first k dimensions."""
    return np.sqrt(np.concatenate([np.zeros((len(matrix), 1)), np.cumsum(matrix * matrix, axis=1)], axis=1))


def left_out(row_norms: np.ndarray, anchor_norms: np.ndarray, threshold: float) -> np.ndarray:
    """How many leading dimensions of each row the index leaves out."""
    covered = row_norms * anchor_norms.max(axis=0) * _MARGIN < threshold
    return np.maximum(covered.sum(axis=1) - 1, 0)


def pairs_above(anchors: np.ndarray, rows: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs whose score reaches the anchor's threshold."""
    order = np.argsort((rows * rows).sum(axis=0), kind="stable")
    anchors, rows = np.ascontiguousarray(anchors[:, order]), np.ascontiguousarray(rows[:, order])
    anchor_norms, row_norms = _prefix_norms(anchors), _prefix_norms(rows)
    first = left_out(row_norms, anchor_norms, thresholds.min())
    live = np.flatnonzero(first < rows.shape[1]) if thresholds.min() > 0 else np.arange(len(rows))
    # The index begins at a step's edge, and rows go by where theirs begins: those a step adds to come first.
    first = first // STEP * STEP
    live = live[np.argsort(first[live], kind="stable")]
    found = [_pairs_of(anchors, anchor_norms, rows[part], row_norms[part], first[part], thresholds, part)
             for part in (live[at:at + TILE_ROWS] for at in range(0, len(live), TILE_ROWS))]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    anchor, row, score = (np.concatenate(c) for c in zip(*found, strict=True))
    return anchor, row, score


def _pairs_of(anchors: np.ndarray, anchor_norms: np.ndarray, rows: np.ndarray, row_norms: np.ndarray, first: np.ndarray,
              thresholds: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for a few rows, in rising order of ``first``, whose dimensions and norms are in the index's order."""
    scores = np.zeros((len(rows), len(anchors)))
    for low in range((rows.shape[1] - 1) // STEP * STEP, -1, -STEP):
        n = int(np.searchsorted(first, low, side="right"))  # the index of the others has no dimensions from here down
        if not n:
            break
        scores[:n] += rows[:n, low:low + STEP] @ anchors[:, low:low + STEP].T
        # What the dimensions below, in the index or not, can still add.
        most = np.multiply.outer(row_norms[:n, low] * _MARGIN, anchor_norms[:, low])
        most += scores[:n]
        kept = (most >= thresholds).any(axis=1)
        if not kept.all():
            kept = np.append(kept, np.ones(len(first) - n, bool))
            rows, row_norms, first, numbers, scores = rows[kept], row_norms[kept], first[kept], numbers[kept], scores[kept]
    outer = np.flatnonzero(first)
    bound = scores
    if len(outer):
        bound = scores.copy()
        bound[outer] += anchor_norms.T[first[outer]] * (row_norms[outer, first[outer]] * _MARGIN)[:, None]
    row, anchor = np.nonzero(bound >= thresholds)
    score = scores[row, anchor]
    if len(outer):
        open_pairs = np.flatnonzero(first[row])
        for start in range(0, len(open_pairs), 1 << 16):
            part = open_pairs[start:start + (1 << 16)]
            outside = np.where(np.arange(rows.shape[1]) < first[row[part], None], rows[row[part]], 0)
            score[part] += np.einsum("ij,ij->i", anchors[anchor[part]], outside)
    kept = score >= thresholds[anchor]
    return anchor[kept], numbers[row[kept]], score[kept]


def _exact_pairs(anchors: pa.ChunkedArray, rows: pa.ChunkedArray, thresholds: np.ndarray):
    """The same for components of any size, in whole numbers."""
    spelled = [[[floor(Fraction(x) * SCALE) for x in v] for v in side.to_pylist()] for side in (anchors, rows)]
    found = []
    for i, a in enumerate(spelled[0]):
        for j, b in enumerate(spelled[1]):
            score = sum(x * y for x, y in zip(a, b, strict=False))
            if score >= thresholds[i]:
                found.append((i, j, max(min(score, _LONGEST), -_LONGEST)))
    columns = list(zip(*found)) or [(), (), ()]
    return np.array(columns[0], np.int64), np.array(columns[1], np.int64), np.array(columns[2], object)


def _all_above(anchors: pa.Table, rows: pa.Table, thresholds: np.ndarray):
    sides = [t.column("embedding") for t in (anchors, rows)]
    width = max(1, *(pc.max(pc.list_value_length(side)).as_py() or 0 for side in sides))
    a, b = (quantised(side, width) for side in sides)
    with np.errstate(over="ignore", invalid="ignore"):
        longest = np.sqrt((a * a).sum(axis=1)).max() * np.sqrt((b * b).sum(axis=1)).max()
    # An overflow gives infinity, or no number times zero.
    return pairs_above(a, b, thresholds) if longest < _EXACT else _exact_pairs(*sides, thresholds)


_FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def _meet(rows: DataFrame, anchors: DataFrame, blocks: int, parts: int, pick: Callable) -> DataFrame:
    """Every block of rows with every part of the anchors; ``pick`` chooses among the pairs found."""
    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            thresholds = np.asarray(right.column("threshold"), np.float64)
            anchor, row, score = _all_above(right, left, thresholds)
            ids = np.asarray(left.column("vec_id"), np.int64)[row]
            same = np.asarray(left.column("label"), np.int64)[row] == np.asarray(right.column("label"), np.int64)[anchor]
            own = np.asarray(right.column("anchor_id"), np.int64)
            order = np.lexsort((ids, -score.astype(np.float64))) if score.dtype != object else \
                np.array(sorted(range(len(ids)), key=lambda i: (-score[i], ids[i])), np.int64)
            order = order[np.argsort(anchor[order], kind="stable")]
            bounds = np.searchsorted(anchor[order], np.arange(right.num_rows + 1))
            extra = [right.column(c).to_pylist() for c in right.column_names if c in ("positive_ids", "positive_scores", "cuts")]
            for i in range(right.num_rows):
                at = order[bounds[i]:bounds[i + 1]]
                at = at[ids[at] != own[i]]
                pick(out, int(own[i]), at, ids, same, score, *(e[i] for e in extra))
        return pa.table([pa.array(c, pa.int64()) for c in out],
                        names=["anchor_id", "positive_id", "positive_score", "vec_id", "score"])

    left = rows.withColumn("part", numbers(parts)).groupBy("block", "part")
    right = anchors.withColumn("block", numbers(blocks)).groupBy("block", "part")
    return left.cogroup(right).applyInArrow(meet, _FOUND)


def _put(out: list[list], anchor: int, positive, positive_score, at, ids, score) -> None:
    for column, values in zip(out, ([anchor] * len(at), [positive] * len(at), [positive_score] * len(at),
                                    ids[at].tolist(), [int(s) for s in score[at]]), strict=True):
        column.extend(values)


def window(positive_score: int) -> tuple[int, int]:
    """The negatives' scores: from half of the positive's to 95 hundredths of it."""
    return -(-positive_score // 2), 19 * positive_score // 20


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has vec_id, label and embedding; ``is_anchor`` is a condition on
    its columns. An anchor's positives are the ``positives`` best other rows of
    its label, its negatives the ``negatives`` best rows of other labels within
    the window of each positive; ties go to the smaller vec_id.

    Rows with a null vec_id, label or vector or with a null or non-finite
    component take no part. Vectors of different lengths are filled up with
    zeros. A vec_id that repeats counts once, by its row of smallest label and
    vector. Empty tables give no rows. Other columns are not read.
    """
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    cells = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                            F.col("embedding").cast("array<double>").alias("embedding"),
                            F.coalesce(is_anchor, F.lit(False)).alias("_anchor"))
             .where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(~odd))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.pow(F.floor(F.least(F.abs(x), F.lit(1e12)) * SCALE), F.lit(2.0))))
    one = F.min(F.struct("label", "embedding", "_anchor"))
    cells = cells.groupBy("vec_id").agg(one.alias("_one")).select("vec_id", "_one.*")
    cells = written(cells.withColumn("norm", norm), "cells")
    n, longest = cells.agg(F.count(F.lit(1)), F.max("norm")).first()
    blocks = max(1, -(-n // BLOCK_ROWS))
    rows = cells.select("vec_id", "label", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
    anchors = cells.where("_anchor").select(F.col("vec_id").alias("anchor_id"), "label", "embedding", "norm")
    anchors = written(anchors, "anchors")
    parts = max(1, -(-anchors.count() // BLOCK_ANCHORS))
    anchors = anchors.withColumn("part", F.pmod(F.xxhash64("anchor_id"), F.lit(parts)))

    def pick_positives(out, own, at, ids, same, score) -> None:
        _put(out, own, None, None, at[same[at]][:positives], ids, score)

    def pick_negatives(out, own, at, ids, same, score, positive_ids, positive_scores, cuts) -> None:
        at = at[~same[at]]
        found = score[at]
        for positive, value, cut in zip(positive_ids, positive_scores, cuts, strict=True):
            inside = at[(found >= cut) & (found <= window(value)[1])][:negatives]
            _put(out, own, positive, value, inside, ids, score)

    def full(got: DataFrame, keys: list[str], wanted: int) -> DataFrame:
        return got.groupBy(*keys).count().where(F.col("count") >= wanted).select(*keys)

    found, waiting = [], anchors
    for share in (*POSITIVE_SHARES, None):
        threshold = F.lit(float("-inf")) if share is None else F.col("norm") * F.lit(share * (longest or 0.0))
        got = _meet(rows, waiting.withColumn("threshold", threshold), blocks, parts, pick_positives)
        got = written(top_n_per(got, ["anchor_id"], [F.desc("score"), F.asc("vec_id")], positives), "positives")
        if share is None:
            found.append(got)
            break
        done = full(got, ["anchor_id"], positives)
        found.append(got.join(done, "anchor_id", "left_semi"))
        waiting = written(waiting.join(done, "anchor_id", "left_anti"), "waiting")
        if waiting.isEmpty():
            break
    chosen = found[0]
    for more in found[1:]:
        chosen = chosen.unionByName(more)
    lower, upper = F.expr("positive_score - positive_score div 2"), F.expr("(19 * cast(positive_score AS decimal(38, 0))) div 20")
    windows = written(chosen.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
                      .where("positive_score >= 0").withColumns({"lower": lower, "upper": upper.cast("long")})
                      .where("lower <= upper"), "windows")
    results = []
    for share in (*NEGATIVE_SHARES, None):
        cut = F.col("lower") if share is None else F.greatest("lower", F.floor(F.col("upper") * share))
        asked = windows.withColumn("cut", cut).groupBy("anchor_id").agg(
            F.collect_list(F.struct("positive_id", "positive_score", "cut")).alias("_w"), F.min("cut").cast("double").alias("threshold"))
        asked = asked.join(anchors, "anchor_id").select(
            "anchor_id", "label", "embedding", "part", "threshold", F.col("_w.positive_id").alias("positive_ids"),
            F.col("_w.positive_score").alias("positive_scores"), F.col("_w.cut").alias("cuts"))
        got = _meet(rows, asked, blocks, parts, pick_negatives)
        keys = ["anchor_id", "positive_id"]
        got = written(top_n_per(got, keys, [F.desc("score"), F.asc("vec_id")], negatives), "negatives")
        if share is None:
            results.append(got)
            break
        done = full(got, keys, negatives)
        results.append(got.join(done, keys, "left_semi"))
        windows = written(windows.join(done, keys, "left_anti"), "windows")
        if windows.isEmpty():
            break
    every = results[0]
    for more in results[1:]:
        every = every.unionByName(more)
    return every.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                        F.col("score").alias("negative_score"))
