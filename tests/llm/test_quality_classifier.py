import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import quality_classifier as qc
from tests.llm.helpers import EDGE_TEXTS, SMALL, SPACE_WORDS, edge_docs, empty_docs, low, table


def plain_grams(text):
    """The n-grams of a text as tuples, by their definition."""
    data = (text or "").encode()
    words = [w.encode() for w in SPACE_WORDS.findall(low(text))]
    plain = bytes(0x20 if b == 0x20 or 9 <= b <= 13 else b for b in data)
    return ({("w", w) for w in words} | {("w", *p) for p in zip(words, words[1:])} | {("b", plain[i:i + 3]) for i in range(len(plain) - 2)}
            | {("same", k) for k in qc.ECHOES if any(a == b for a, b in zip(words, words[k:]))})


def test_cells_are_the_ngrams():
    texts = [t for t in EDGE_TEXTS if len(t or "") < 1000] + ["a b a b", "x y z w x", "the the", "ab"]
    for text, cells in zip(texts, qc._cells(pa.array(texts, pa.string()))):
        n = len(plain_grams(text))
        assert len(set(cells.tolist())) == len(cells) and n - 2 <= len(cells) <= n      # two n-grams may share a cell
    alone = [sorted(next(qc._cells(pa.array([t], pa.string()))).tolist()) for t in texts]
    assert alone == [sorted(c.tolist()) for c in qc._cells(pa.array(texts, pa.string()))]


def test_ratios_equal_their_definition():
    sets, good = [np.array([1, 2]), np.array([2]), np.array([3, 2])], np.array([True, True, False])
    r = qc.count_ratios(sets, good)
    size = 1 << qc.BITS
    for cell, n1, n0 in ((1, 1, 0), (2, 2, 1), (3, 0, 1)):
        assert r[cell] == pytest.approx(np.log((n1 + 1) / (3 + size)) - np.log((n0 + 1) / (2 + size)))
    assert r[0] == 0 and np.count_nonzero(r) == 3


def test_dual_descent_reaches_the_optimum():
    """Against projected gradient steps on the whole dual problem."""
    random = np.random.default_rng(7)
    x, y = random.normal(size=(40, 6)), np.where(random.random(40) < 0.5, 1.0, -1.0)
    x[:, 0] += y
    box = np.where(y > 0, 0.7, 1.3)
    w, bias, alpha = qc.dual_descent([(np.arange(6), r) for r in x], y, box, 6, epochs=3000, settled=1e-9)
    full = np.hstack([x, np.ones((40, 1))]) * y[:, None]
    q, a = full @ full.T, np.zeros(40)
    for _ in range(60_000):
        a = np.clip(a - (q @ a - 1) / np.linalg.eigvalsh(q)[-1], 0, box)
    assert 0.5 * alpha @ q @ alpha - alpha.sum() == pytest.approx(0.5 * a @ q @ a - a.sum(), abs=1e-6)
    assert np.allclose(np.append(w, bias), full.T @ alpha)
    primal = 0.5 * (w @ w + bias**2) + (box * np.maximum(0, 1 - y * (x @ w + bias))).sum()
    assert primal == pytest.approx(alpha.sum() - 0.5 * alpha @ q @ alpha, abs=1e-5)      # no gap


def test_logistic_recovers_a_slope():
    random = np.random.default_rng(1)
    m = random.normal(size=20_000)
    slope, base = qc.logistic(m, random.random(20_000) < 1 / (1 + np.exp(-(2 * m + 0.5))))
    assert slope == pytest.approx(2, abs=0.15) and base == pytest.approx(0.5, abs=0.1)


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    scored = qc.op13_quality_classifier(spark, d)
    rows = scored.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == k] for k in (1, 0))
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.99
    assert sum(s < 0.7 for s in good) <= 0.02 * len(good) and sum(s >= 0.7 for s in bad) <= 0.1 * len(bad)
    assert scored.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


def test_edges(spark):
    model = qc.fit(table(spark, "documents"), table(spark, "labels"), qc.remainder() == 2, qc.remainder() == 1)
    docs = edge_docs(spark)
    rows = qc.score_documents(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    same = {r.doc_id: r.score for r in rows}
    assert same[0] == same[1] and same[5] == same[6]
    assert qc.score_documents(empty_docs(spark), model).count() == 0


def test_missing_labels(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    fitted = lambda own: qc.fit(docs, own, F.lit(False), F.lit(False))
    assert {r.score for r in qc.score_documents(docs, fitted(labels.limit(0))).collect()} == {0.5}
    n = labels.where("quality = 1").count()
    one = {r.score for r in qc.score_documents(docs, fitted(labels.where("quality = 1"))).collect()}
    assert len(one) == 1 and one.pop() == pytest.approx((n + 1) / (n + 2))


def test_the_sample_is_bounded_and_settled(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(qc, "train", lambda sets, good, calibration: seen.append((len(sets), sum(map(len, sets)))))
    docs, labels = table(spark, "documents"), table(spark, "labels")
    qc.fit(docs.unionByName(docs), labels, F.lit(False), F.lit(False), labelled=30)
    qc.fit(docs, labels, F.lit(False), F.lit(False), features=20_000)
    assert seen[0][0] <= 30 and 0 < seen[1][1] <= 20_000


def test_query_columns(spark):
    assert {"doc_id", "held_out", "score", "predicted"} <= set(qc.op13_quality_classifier(spark, SMALL).columns)
