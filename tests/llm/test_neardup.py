import random
from hashlib import sha256

import numpy as np
import pytest

from ledgerlens.llm import neardup
from ledgerlens.llm.graph import components
from tests.llm.helpers import SMALL, SPACE_WORDS, docs_of, edge_docs, empty_docs, low, table


def sets_of(docs, n):
    out = []
    for d, t in docs:
        w = SPACE_WORDS.findall(low(t))
        out.append((d, {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())))
    return out


def plain(docs, n):
    sets, parent = sets_of(docs, n), list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    smallest, least = {}, {}
    for i, (d, s) in enumerate(sets):
        key = sha256((docs[i][1] or "").encode()).digest()
        least[root(i)] = min(key, least.get(root(i), key))
        if d is not None:
            smallest[root(i)] = min(d, smallest.get(root(i), d))
    out = []
    for i, (d, s) in enumerate(sets):
        component = smallest.get(root(i))
        alone = component is None and s
        kept = sha256(docs[i][1].encode()).digest() == least[root(i)] if alone else d == component
        out.append((d, len(s), component, kept))
    return sorted(out, key=str)


def plain_left(docs, n):
    """One row of each group: that of the smallest (id, null ones last, and SHA-256 of the text); rows without words all stay."""
    sets = sets_of(docs, n)
    left = [(d, t) for (d, t), (_, s) in zip(docs, sets) if not s]
    groups = []
    for (d, t), (_, s) in zip(docs, sets):
        if s:
            linked = [g for g in groups if any(100 * len(s & o) >= 80 * len(s | o) for _, _, o in g)]
            groups = [g for g in groups if g not in linked] + [[x for g in linked for x in g] + [(d, t, s)]]
    left += [min(g, key=lambda x: (x[0] is None, x[0] or 0, sha256(x[1].encode()).digest()))[:2] for g in groups]
    return sorted(left, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_small_table(spark):
    assert got(neardup.op5_near_duplicates(spark, SMALL)) == plain(docs_of(table(spark, "documents")), 4)


def test_edges(spark):
    docs = edge_docs(spark)
    assert got(neardup.near_duplicates(docs, 3)) == plain(docs_of(docs), 3)
    assert neardup.near_duplicates(empty_docs(spark)).count() == 0


A = "the first text has some ten words of its own here"
B = "quite another text with as many words but other ones instead of those"
C = " ".join(f"word{i}" for i in range(60))
#: Ids that several texts share, and null ones.
SHARED = [
    [(3, A), (7, A), (7, B)],
    [(None, C), (None, C + " more"), (None, A)],
    [(5, A), (5, C), (8, C + " more")],
    [(5, A), (5, C), (5, C + " more"), (None, C), (9, A), (9, A), (4, ""), (4, ""), (None, None), (6, B), (6, B)],
    [(None, B)] * 3 + [(None, C)] * 2 + [(2, C + " end")],
]


@pytest.mark.parametrize("rows", SHARED)
def test_ids_of_several_texts_and_null_ids(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, text_key string, component int")
    assert got(neardup.near_duplicates(docs)) == plain(rows, 5)
    left = neardup.without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(docs_of(left), key=str) == plain_left(rows, 5)


def test_many_null_ids_in_one_group(spark):
    rows = [(None if i % 3 else i, C if i % 2 else C + f" end{i % 5}") for i in range(300)] + [(1000 + i, f"own text number {i} is here") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert got(neardup.near_duplicates(docs)) == plain(rows, 5)
    assert sorted(docs_of(neardup.without_near_duplicates(docs)), key=str) == plain_left(rows, 5)


@pytest.mark.parametrize("block", [1_000_000, 300])
def test_groups_of_edited_copies(spark, monkeypatch, block):
    """A group around the threshold: links that the central member doesn't give, over one block and over many."""
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", block)
    r = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    docs = []
    for g in range(3):
        base = [r.choice(words) for _ in range(120)]
        for k in range(40):
            own = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 4, 6, 9])):
                own[r.randrange(len(own))] = r.choice(words)
            docs.append((1000 * g + k, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(neardup.near_duplicates(df, 4)) == plain(docs, 4)


def test_every_coordinate_fills_and_estimates():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 2**63, 400).astype(np.uint64), r.integers(0, 2**63, 100).astype(np.uint64)
    one = np.sort(a)
    two = np.sort(np.concatenate([a[:350], b[:50]]))
    single = a[:1]
    elements, first = np.concatenate([one, two, single]), np.cumsum([0, len(one), len(two), 1])
    sketch = neardup.sketches(elements, first, 240)
    assert (sketch != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((sketch[0] == sketch[1]).mean() - 350 / 450) < 0.12


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    out = {r.id: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert out == {**{i: 1 for i in range(1, 61)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
