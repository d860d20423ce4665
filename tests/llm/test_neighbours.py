import numpy as np

from clientlens.llm import neighbours


def brute(ids, x, query, k):
    score = (x * query[1]).sum(1)
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != query[0]]
    return [(int(ids[i]), float(score[i])) for i in order[:k]]


def hold(found, ids, x, queries, k):
    """Ranks, scores and order are right; the share of true neighbours found."""
    by = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r)
    value = dict(zip(ids.tolist(), x, strict=True))
    hits = total = 0
    for q in queries:
        rows, truth = by[int(q)], brute(ids, x, (q, value[int(q)]), k)
        assert [r["rank"] for r in rows] == list(range(1, len(truth) + 1))
        assert all(abs(r.score - value[r.vec_id] @ value[int(q)]) < 1e-9 * max(1, abs(r.score)) for r in rows)
        assert sorted(rows, key=lambda r: (-r.score, r.vec_id)) == rows
        hits += len({r.vec_id for r in rows} & {i for i, _ in truth})
        total += len(truth)
    return hits / total


def test_recall_on_the_table(spark):
    from clientlens.llm.queries import op5

    for sf in ("sf0.01", "sf0.1"):
        rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").orderBy("vec_id").collect()
        ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
        assert hold(op5(spark, f"/root/testdata/{sf}").collect(), ids, x, ids[ids % 20 == 0], 20) >= 0.9


def test_blocks_lengths_and_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "INDEX_BLOCK", 150)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 12)) * rng.uniform(0.5, 3, (900, 1))
    x[200:500] = x[0]  # a third are copies
    ids = rng.permutation(900)
    vectors = spark.createDataFrame([(int(i), v.tolist(), "s") for i, v in zip(ids, x, strict=True)],
                                    "vec_id long, embedding array<double>, score string")
    found = neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), 10).collect()
    assert hold(found, ids, x, ids[ids % 20 == 0], 10) >= 0.9
    exact = neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), 10, probes=1.0).collect()
    assert hold(exact, ids, x, ids[ids % 20 == 0], 10) == 1


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]),
            (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (9, []), (None, [1.0, 1.0]), (40, None), (1, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == [
        (0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 1, 2.0), (20, 2, 2, 2.0), (20, 3, 0, 0.0)]
    none = vectors.limit(0)
    assert neighbours.nearest(none, none).count() == 0


def test_queries_of_another_length_take_no_part(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 19)] + [(20, [1.0, 2.0, 3.0]), (40, [1.0, 0.0, 0.0]), (60, [2.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), 3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == [(60, 1, 18, 37.0), (60, 2, 17, 35.0), (60, 3, 16, 33.0)]
    odd = vectors.where("vec_id IN (20, 40)")
    assert neighbours.nearest(vectors, odd, 3).count() == 0


def test_equal_products_rank_by_id_and_few_vectors_give_k_rows():
    import numpy as np

    from clientlens.llm import neighbours

    rng = np.random.default_rng(2)
    tied = np.hstack([np.ones((200, 1)), rng.standard_normal((200, 3))])
    ids = rng.permutation(200)
    norm = float(np.linalg.norm(tied, axis=1).max())
    found = neighbours._best(ids, tied, np.array([900]), np.array([[1.0, 0, 0, 0]]), norm, 20, 1.0, 2, 24)
    assert found[1] == list(range(20))
    for d in (1, 2, 3):
        few = rng.permutation(np.arange(1, 26))[:, None] * np.ones((1, d)) * 100.0 + rng.uniform(0, 1, (25, d))
        norm = float(np.linalg.norm(few, axis=1).max())
        found = neighbours._best(np.arange(25), few, np.arange(25), few, norm, 20, 0.4, 2, 24)
        assert np.bincount(found[0], minlength=25).tolist() == [20] * 25
