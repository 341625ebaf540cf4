import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import toxicity as tox
from tests.llm.helpers import SMALL, edge_docs, empty_docs, table


def plain_segments(scores):
    """All maximal segments by their definition, recursively."""
    best, where = 0.0, None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > best + 1e-12:
                best, where = total, (a, b + 1)
    if where is None:
        return []
    a, b = where
    left = [(x, y, s) for x, y, s in plain_segments(scores[:a])]
    right = [(x + b, y + b, s) for x, y, s in plain_segments(scores[b:])]
    return left + [(a, b, best)] + right


def test_segments_equal_their_definition():
    r = random.Random(4)
    for _ in range(300):
        scores = [r.choice([-3, -2, -1.5, -1, 0.7, 1.3, 2.1, 4.05]) + r.random() / 100 for _ in range(r.randrange(0, 30))]
        got = tox.maximal_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in plain_segments(scores)]
        assert all(s == pytest.approx(sum(scores[a:b])) for a, b, s in got)


def test_long_walks_are_linear():
    assert len(tox.maximal_segments([1.0, -2.0] * 200_000)) == 200_000
    assert len(tox.maximal_segments([1.0, -0.5] * 200_000)) == 1


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    scored = tox.op7_toxicity(spark, d)
    rows = scored.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = ([r.score for r in rows if r.toxic == k] for k in (1, 0))
    auc = sum((t > c) + (t == c) / 2 for t in toxic for c in clean) / (len(toxic) * len(clean))
    assert auc > 0.97
    assert sum(s >= 0.5 for s in clean) <= 0.03 * len(clean)
    assert scored.count() == spark.read.parquet(f"{d}/documents.parquet").count()


def test_edges(spark):
    labels = table(spark, "labels")
    model = tox.fit(table(spark, "documents"), labels, tox.remainder() == 0, tox.remainder() == 1)
    docs = edge_docs(spark)
    rows = tox.score_documents(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert tox.score_documents(empty_docs(spark), model).count() == 0
    assert tox.without_toxic(docs, model).columns == docs.columns
    same = {r.doc_id: r.score for r in rows}
    assert same[0] == same[1] == same[2]


def test_no_labels(spark):
    none = table(spark, "labels").limit(0)
    model = tox.fit(table(spark, "documents"), none, tox.remainder() == 0, tox.remainder() == 1)
    scores = {r.score for r in tox.score_documents(table(spark, "documents"), model).collect()}
    assert scores == {0.5}


def test_passages_are_where_the_words_are(spark):
    bad = ["vilewordone", "vilewordtwo", "vilewordthree"]
    r = random.Random(1)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(plain) for _ in range(60)]
        if i % 5 == 0:
            w[20:23] = bad
        rows.append((i, "é " + " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = tox.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), tox.remainder() == 0, tox.remainder() == 1)
    texts = dict(rows)
    for x in tox.score_documents(docs, model).collect():
        assert x.predicted == (x.doc_id % 5 == 0)
        if x.predicted:
            found = [texts[x.doc_id][a:b] for a, b in (map(int, p.split(":")) for p in x.passages.split(","))]
            assert any(bad[1] in p and len(p) < 90 for p in found)     # chance neighbours may be taken along
    assert tox.without_toxic(docs, model).count() == 480


def test_fit_is_bounded(spark):
    small = tox.fit(table(spark, "documents"), table(spark, "labels"), F.lit(False), tox.remainder() == 1, labelled=10)
    assert small.scores.shape == (1 << tox.BITS,)
