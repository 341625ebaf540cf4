import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import lm
from tests.llm.helpers import SMALL, SPACE_WORDS, docs_of, edge_docs, empty_docs, low, table


def fold(doc):
    return zlib.crc32(str(doc).encode()) % 5


def plain(docs, weights):
    """Scores by dictionaries; weights: as learned."""
    sequences = [(d, SPACE_WORDS.findall(low(t)) + [None]) for d, t in docs]
    one, two, context = Counter(), Counter(), Counter()
    for d, s in sequences:
        if d is None or fold(d) != 1:
            for before, w in zip(["<begin>", *s], s):
                one[w] += 1
                two[before, w] += 1
                context[before] += 1
    n, v = sum(one.values()), len(one)
    out = []
    for d, s in sequences:
        base = sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in s)
        score = 0.0
        for before, w in zip(["<begin>", *s], s):
            c = context[before]
            b = lm.BUCKETS + int(math.log2(c)) + 1 if c else 0
            lam = weights.get(b) or ([1 / 3] * 3 if c else [0.5, 0.5, 0.0])
            score += math.log10(lam[0] / (v + 1) + lam[1] * one[w] / max(n, 1) + (lam[2] * two[before, w] / c if c else 0))
        out.append((d, d is not None and fold(d) == 1, len(s), sum(one[w] > 0 for w in s), n, base, score))
    return out


@pytest.fixture()
def learned(monkeypatch):
    kept = {}
    learn = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda *a: kept.setdefault("weights", learn(*a)))
    return kept


def held(spark, docs, learned):
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    got = [tuple(r) for r in lm.score_documents(docs, remainder == 1, remainder == 0).collect()]
    want = plain(docs_of(docs), learned["weights"])
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)
    return got


def test_small_table(spark, learned):
    got = held(spark, table(spark, "documents"), learned)
    tested = [r for r in got if r[1]]
    assert sum(r[6] for r in tested) > sum(r[5] for r in tested)     # likelier than by single words


def test_edges(spark, learned):
    held(spark, edge_docs(spark), learned)


def test_empty(spark):
    assert lm.score_documents(empty_docs(spark), F.lit(False), F.lit(False)).count() == 0


def test_nothing_to_learn_from(spark):
    rows = lm.score_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True), F.lit(False)).collect()
    assert [tuple(r)[:5] for r in rows] == [(1, True, 3, 0, 0)] and rows[0].base_score == 0


def test_weights_climb_to_the_likeliest_mix():
    # a bucket whose tokens the 2-gram estimate alone explains
    code = (lm.BUCKETS + 1) * (lm.OCTAVES * lm.STEPS) + 40
    weights = lm.learn_weights([(code * (lm.OCTAVES * lm.STEPS) + 1, 1000)], 2, 10_000)
    (lam,) = weights.values()
    assert lam[2] > 0.99 and sum(lam) == pytest.approx(1)


def test_works_on_orders_one_and_three(spark):
    docs = table(spark, "documents").limit(60)
    for order in (1, 3):
        remainder = F.crc32(F.col("doc_id").cast("string")) % 5
        rows = lm.score_documents(docs, remainder == 1, remainder == 0, order=order).collect()
        assert len(rows) == 60 and all(r.score < 0 for r in rows)
