"""Hard negatives against brute force, and the bounds of the threshold join."""

import tracemalloc
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientlens.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>, score string, part int, block int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 1) for r in rows], SCHEMA)


def brute(rows, every):
    cells = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            cells.append((i, label, v))
    first = {}
    for i, label, v in sorted(cells, reverse=True):
        first[i] = (label, v)
    cells = [(i, label, [floor(256 * x) for x in v]) for i, (label, v) in first.items()]
    out = set()
    for anchor, label, v in cells:
        if anchor % every:
            continue
        ranked = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in cells if i != anchor)
        for s, p, _ in [r for r in ranked if r[2] == label][:5]:
            fits = [r for r in ranked if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out |= {(anchor, p, n, q, -s, -t) for n, (t, q, _) in enumerate(fits, 1)}
    return out


def found(spark, rows, every):
    got = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % every == 0).collect()
    return {tuple(r) for r in got}, len(got)


def test_equals_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 64)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 12)) / 3
    rows = [(i, int(rng.integers(3)), (centres[i % 4] + rng.normal(size=12) / 5).tolist()) for i in range(400)]
    rows += [(1000 + i, i % 3, rows[0][2]) for i in range(120)]  # copies: a third of the rows and of all scores alike
    got, n = found(spark, rows, 10)
    assert got == brute(rows, 10) and len(got) == n > 100


def test_odd_rows(spark):
    v = [0.5, -0.25, 0.75]
    rows = [(0, 1, v), (1, 1, v), (2, 2, [0.3, -0.2, 0.4]), (3, 2, [0.3, -0.2]), (4, 2, [0.3, -0.2, 0.4, 9.0]), (5, None, v), (6, 1, None),
            (7, 2, [None, 1.0, 1.0]), (8, 2, [float("nan"), 1.0, 1.0]), (9, 2, [float("inf"), 1.0, 1.0]), (None, 2, [0.3, -0.2, 0.4]),
            (10, 3, []), (20, 1, v), (20, 1, v), (11, 2, [0.3, -0.2, 0.4]), (11, 2, [0.3, -0.2, 0.4]), (30, 5, v), (40, 1, [-x for x in v])]
    expected = brute(rows, 10)
    assert found(spark, rows, 10)[0] == expected and expected
    assert negatives.hard_negatives(frame(spark, rows).limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_large_components_are_exact(spark):
    rows = [(0, 1, [2.0**30, 3.0]), (1, 1, [2.0**9, 1.0]), (2, 2, [2.0**8 + 1, 7.0]), (3, 2, [2.0**8 + 1, 7.5]), (4, 3, [1e200, 1.0])]
    assert found(spark, rows[:4], 10)[0] == brute(rows[:4], 10) != set()
    assert found(spark, rows, 10)[0] == brute(rows[:4], 10)


@pytest.mark.parametrize("share", [0.9, 0.5, 0.0, -np.inf])
def test_threshold_join_loses_nothing_and_leaves_dimensions_out(share):
    rng = np.random.default_rng(int(max(share, 0) * 10))
    rows = np.floor(256 * rng.normal(size=(300, 24)) * np.geomspace(0.05, 1, 24))
    anchors = rows[:40]
    norms = np.linalg.norm(anchors, axis=1)
    thresholds = norms * norms.max() * share if np.isfinite(share) else np.full(40, -np.inf)
    a, r, s = negatives.pairs_above(anchors, rows, thresholds)
    exact = anchors @ rows.T
    assert set(zip(a.tolist(), r.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(exact >= thresholds[:, None]))))
    assert (s == exact[a, r]).all()
    order = np.argsort((rows * rows).sum(axis=0))
    left_out = negatives.left_out(negatives._prefix_norms(rows[:, order]), negatives._prefix_norms(anchors[:, order]), thresholds.min())
    assert (left_out.mean() > 3) if share > 0 else (left_out == 0).all()


def test_partial_scores_are_held_for_a_few_rows_at_a_time():
    """Scores of all rows with all anchors at once left the processor's cache in every step."""
    rng = np.random.default_rng(8)
    scale = rng.choice([0, 1, 40], 21)
    anchors = np.floor(rng.normal(size=(64, 21)) * scale * 10)
    rows = np.floor(rng.normal(size=(20_000, 21)) * scale * 10 * rng.random((20_000, 1)) ** 3)
    scores = anchors @ rows.T
    for thresholds in (np.quantile(scores, 0.999, axis=1), np.full(64, scores.max()), np.where(np.arange(64) % 2, -np.inf, scores.max() * 2)):
        tracemalloc.start()
        anchor, row, score = negatives.pairs_above(anchors, rows, thresholds)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sorted(zip(anchor, row, score)) == [(i, j, scores[i, j]) for i, j in zip(*np.nonzero(scores >= thresholds[:, None]))]
        assert len(row) > 50_000 or peak < 3 * scores.nbytes
