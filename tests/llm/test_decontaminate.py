import hashlib

from ledgerlens.llm import decontaminate as de
from tests.llm.helpers import ALNUM_WORDS, SMALL, docs_of, edge_docs, empty_docs, low, table


def plain(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = ALNUM_WORDS.findall(low(text))
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    lengths = {len(k) for k in windows}
    out = []
    for d, text in docs:
        w, hit, found = ALNUM_WORDS.findall(low(text)), set(), set()
        for size in lengths:
            for i in range(len(w) - size + 1):
                for item in windows.get(tuple(w[i:i + size]), ()):
                    found.add(item)
                    hit |= set(range(i, i + size))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_small_table(spark):
    items = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    want = plain(docs_of(table(spark, "documents")), items)
    assert got(de.op10_decontaminate(spark, SMALL)) == want and any(r[5] for r in want)


def test_edges(spark):
    docs = edge_docs(spark)
    items = [(1, None), (2, ""), (3, "tick"), (4, "Two words"), (4, "two WORDS"), (5, "tock tick " * 7), (6, "same text here again"), (6, "a b")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    assert got(de.contamination(docs, bench)) == plain(docs_of(docs), items)
    assert de.contamination(empty_docs(spark), bench).count() == 0
    assert not any(r.contaminated for r in de.contamination(docs, bench.limit(0)).collect())


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr(de, "PHRASES_PER_PASS", 7)
    items = [(r.item_id, r.text) for r in table(spark, "benchmark").limit(3).collect()]
    docs = table(spark, "documents")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(de.contamination(docs, bench)) == plain(docs_of(docs), items)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha y y y beta gamma"), (3, "alpha beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    index = de.build_index(docs)
    assert {r.doc_id for r in de.occurrences(index, items).collect()} == {3}
    assert {r.doc_id for r in de.occurrences(index, items, slop=1).collect()} == {1, 3}


def test_rows_with_one_id_or_none_have_their_own_hits(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(None, f"a {item} b"), (None, "clean words only"), (7, "clean too"), (7, item), (7, None), (8, item), (8, item)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, text_key string")
    items = spark.createDataFrame([("i1", item), (None, "clean too")], "item_id string, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in de.contamination(docs, items).collect()), key=str)
    assert got == sorted([(None, 13, 11, 1), (None, 3, 0, 0), (7, 2, 2, 0), (7, 11, 11, 1), (7, 0, 0, 0), (8, 11, 11, 1), (8, 11, 11, 1)], key=str)
    left = de.without_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == [(7, None), (None, "clean words only")]
