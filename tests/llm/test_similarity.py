import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from clientlens.llm import graphs, similarity
from clientlens.llm.common import documents
from tests.llm.odd import lower, no_documents, odd_documents, words


def by_brute_force(rows):
    """{id: (shingles, component)} of unique ids."""
    sets = {}
    for d, t in rows:
        w = words(lower(t))
        sets[d] = frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = defaultdict(list)
    for d in sorted(sets):
        shared = Counter()
        for token in sets[d]:
            shared.update(seen[token])
            seen[token].append(d)
        for e, n in shared.items():
            if 100 * n >= 80 * (len(sets[d]) + len(sets[e]) - n):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def found_of(docs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in similarity.similar_documents(docs).collect()}


def test_documents_of_the_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    assert found_of(docs) == by_brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def planted(seed=6):
    """Copies, near copies at many distances, chains, common passages, and documents that are mostly a passage."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for _ in range(120):
        texts.append(rng.choices(vocabulary, k=rng.randint(3, 150)))
    for base in texts[:40]:
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
    chain = rng.choices(vocabulary, k=120)
    for _ in range(25):  # neighbours are similar, the ends are not
        chain = chain[3:] + rng.choices(vocabulary, k=3)
        texts.append(chain)
    for _ in range(80):
        texts.append(passage + rng.choices(vocabulary, k=rng.randint(0, 90)))
    hub = rng.choices(vocabulary, k=100)
    for _ in range(150):  # a large group of near copies
        copy = list(hub)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(100)] = rng.choice(vocabulary)
        texts.append(copy)
    texts += [texts[0]] * 40
    rng.shuffle(texts)
    return [(3 * i + 1, " ".join(t).upper() if i % 7 == 0 else " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("small", [False, True])
def test_planted_groups(spark, monkeypatch, small):
    if small:  # buckets are split, keys are settled in parts, nothing is broadcast
        for name, value in (("BUCKET", 20), ("HELD", 30), ("LEADERS", 2), ("BATCH_TOKENS", 500), ("SMALL", 0)):
            monkeypatch.setattr(similarity, name, value)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found_of(docs) == by_brute_force(rows)


def test_threshold_is_exact():
    a = np.arange(100)
    assert similarity.similar(a, np.arange(80)) and not similarity.similar(a, np.arange(79))
    assert similarity.similar(np.arange(90), np.arange(10, 100)) == (80 * 100 >= 80 * 100)
    assert not similarity.similar(np.arange(90), np.arange(11, 101))


def test_rows_of_one_key_are_settled_once():
    rows = [(1, 1), (2, 1), (2, 2), (2, 3), (2, 4), (3, 9)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0]]), pa.array([r[1]])], ["a", "b"]) for r in rows]
    similarity.HELD, kept = 2, similarity.HELD
    try:
        seen = [("whole", *(c.tolist() for c in x)) if isinstance(x, list) else x for x in
                similarity._carry(iter(batches), 2, lambda x: x, lambda x: ("part", x[0].tolist(), x[1].tolist()))]
    finally:
        similarity.HELD = kept
    assert seen == [("whole", [1], [1]), ("part", [2, 2, 2], [1, 2, 3]), ("part", [2], [4]), ("whole", [3], [9])]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (101, 100), (200, 200), (7, 100)] + [(300, 300 + i) for i in range(1, 30)]
    found = {r.a: r.root for r in graphs.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in [*range(41), 100, 101, 103]}, **{300 + i: 300 for i in range(30)}}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    docs, rows = odd_documents(spark)
    found = similarity.similar_documents(docs).collect()
    expected = by_brute_force([(d, t) for d, t in rows if d is not None])
    assert len(found) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == {(d, *v) for d, v in expected.items()}
    assert sorted((r.n_shingles, r.component_id) for r in found if r.doc_id is None) == [(0, None), (3, None)]
    assert similarity.similar_documents(no_documents(spark)).count() == 0


def found_elsewhere(n, m, shared):
    """Fewest tokens of the first set's sample in the second's, if all that they do not share have the lowest hashes."""
    sample_n, sample_m = min(n, similarity.sample_size(n)), min(m, similarity.sample_size(m))
    return min(sample_n - (n - shared), sample_m - (m - shared), shared)


def test_samples_of_similar_sets_meet_at_every_pair_of_sizes():
    for n in range(1, 400):
        for m in range(-(-4 * n // 5), 5 * n // 4 + 1):
            shared = -(-4 * (n + m) // 9)
            if m and shared <= min(n, m):
                assert found_elsewhere(n, m, shared) >= max(1, n // 4 + 1 - n // 5), (n, m)


def test_appended_words_at_exactly_the_threshold(spark):
    rng = random.Random(11)
    rows = []
    for n, m in ((4, 5), (8, 10), (9, 11), (12, 15), (24, 30), (28, 35), (44, 55)):  # shingles; 80 of 100 or just above
        for _ in range(40):
            text = [f"{rng.random():.12f}" for _ in range(m + 4)]
            rows += [(len(rows), " ".join(text[:n + 4])), (len(rows) + 1, " ".join(text))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = found_of(docs)
    assert found == by_brute_force(rows)
    assert all(found[d][1] == d - d % 2 for d, _ in rows)


def test_signatures_never_tell_similar_sets_apart():
    rng = np.random.default_rng(3)

    def differing(a, b):
        pairs = zip(similarity.signature(np.sort(a)), similarity.signature(np.sort(b)), strict=True)
        return sum(((x ^ y) & (2 ** 64 - 1)).bit_count() for x, y in pairs)

    for n in (1, 2, 5, 9, 10, 45, 80, 400, 5000):
        for missing, added in ((0, 0), (0, n // 4), (n // 9, n // 9), (n // 5, 0)):
            tokens = rng.integers(-2 ** 62, 2 ** 62, n + added)
            a, b = tokens[:n], tokens[missing:]
            assert similarity.similar(np.sort(a), np.sort(b))
            assert differing(a, b) <= missing + added <= (len(a) + len(b)) / 9
    other = rng.integers(-2 ** 62, 2 ** 62, 5000)
    assert differing(rng.integers(-2 ** 62, 2 ** 62, 5000), other) > 80  # long sets do not fill their signatures
