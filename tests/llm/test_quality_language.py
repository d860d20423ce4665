import zlib

import numpy as np
import pytest

from clientlens.llm import language, quality
from clientlens.llm.common import documents
from tests.llm.odd import no_documents, odd_documents

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_documents(spark):
    from clientlens.llm.queries import op8

    found = {r.doc_id: r for r in op8(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(found) == documents(spark, SF).count()
    held = [d for d in labels if found[d].held_out]
    assert all(found[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in found)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    assert np.mean([found[d].predicted == labels[d] for d in held]) >= 0.97


def test_scores_are_differences_of_log_densities(spark):
    rng = np.random.default_rng(2)
    d = len(quality.STATISTICS)
    x = np.vstack([rng.normal(0, 1, (60, d)), rng.normal(1, 2, (90, d))])
    y = [0] * 60 + [1] * 90
    stats = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "doc_id long, x array<double>")
    labels = spark.createDataFrame(list(enumerate(y)) + [(3, 0), (5, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(stats, labels)
    z = (x - x.mean(0)) / x.std(0)
    log = []
    for k in (0, 1):
        part = z[np.array(y) == k]
        cov = 0.9 * np.cov(part.T, bias=True) + 0.1 * np.eye(d)
        gap = z - part.mean(0)
        log.append(-0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap) - 0.5 * np.linalg.slogdet(cov)[1]
                   + np.log(len(part) / len(z)))
    assert model.scores(x) == pytest.approx(1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500))), rel=1e-6, abs=1e-9)


def test_quality_of_odd_rows(spark):
    docs, rows = odd_documents(spark)
    stats = quality.statistics(docs)
    one_class = spark.createDataFrame([(6, 1), (7, 1)], "doc_id long, quality int")
    for labels, score in ((one_class, 1.0), (one_class.limit(0), 0.5)):
        model = quality.fit(stats, labels)
        assert {r[0] for r in stats.select(quality.score_statistics(model)).collect()} == {score}
    model = quality.fit(stats, spark.createDataFrame([(d, d % 2) for d in range(15)] + [(3, 0), (4, None)], "doc_id long, quality int"))
    a = sorted(r[0] for r in stats.select(quality.score_statistics(model)).collect())
    b = sorted(r[0] for r in docs.select(quality.score_text(model)).collect())
    assert len(a) == len(rows) and a == pytest.approx(b) and 0 <= a[0] and a[-1] <= 1
    assert quality.statistics(no_documents(spark)).count() == 0


def test_gradient_through_time():
    net = language.Network(["a", "b", "c"], hidden=3)
    for d in net.directions:
        d.table, d.gates, d.candidate, d.out = (a.astype(np.float64) for a in d.arrays())
    rng = np.random.default_rng(3)
    data, target = rng.integers(60, 70, (7, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, grads = net.gradients(data, target)
    for array, grad in zip(net.parameters()[:-1], grads, strict=False):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in array.shape)
            if array.shape[1] == 256:
                at = (at[0], int(rng.integers(60, 70)))
            kept, step = array[at], 2e-2
            array[at] = kept + step
            up = net.gradients(data, target)[0]
            array[at] = kept - step
            down = net.gradients(data, target)[0]
            array[at] = kept
            assert grad[at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-4)


def test_language_on_held_out_documents(spark):
    from clientlens.llm.queries import op7

    found = {r.doc_id: r for r in op7(spark, SF).collect()}
    docs = documents(spark, SF).collect()
    assert len(found) == len(docs)
    held = [r for r in docs if found[r.doc_id].held_out]
    assert all(found[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in docs)
    assert np.mean([found[r.doc_id].lang_pred == r.lang for r in held]) >= 0.97


def test_a_text_scores_alike_whatever_it_is_batched_with():
    net = language.Network(["a", "b"], hidden=4)
    texts = [b"x", b"some text " * 50, b"y" * language.SEGMENT, b"z" * (language.SEGMENT + 1)]
    together = net.documents(texts, batch=3)
    for row, text in zip(together, texts, strict=True):
        assert row == pytest.approx(net.documents([text])[0], rel=1e-4)
        assert row.sum() == pytest.approx(1, rel=1e-5)


def test_language_of_odd_rows(spark):
    docs, rows = odd_documents(spark)
    network = language.fit(docs)
    assert network is None or set(network.languages) <= {"en"}
    for net in (network, language.Network(["en", "fr"])):
        found = language.identify(docs, net)
        assert found.count() == len(rows) and found.columns[:-2] == [c for c in docs.columns if c != "lang_pred"]
        for r in found.collect():
            if not r.text or not any(c.isalpha() for c in r.text):
                assert (r.lang_pred, r.lang_score) == ("und", 0.0)
    assert language.fit(no_documents(spark)) is None
    assert language.identify(no_documents(spark), None).count() == 0
