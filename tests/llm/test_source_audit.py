import random
import re

import numpy as np

from ledgerlens.llm import source_audit
from tests.llm.helpers import EDGE_TEXTS, SMALL, edge_docs, empty_docs, low, table

TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=3, top=200):
    """Every term of every pair, in Python's unbounded integers."""
    docs = [(lang or "", source or "", TERMS.findall(low(text))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [(s, w) for g, s, w in docs if g == lang]
        df, total, count = {}, {}, {s: {} for s, _ in own}
        for s, words in own:
            for w in set(words):
                df[w] = df.get(w, 0) + 1
            for w in words:
                total[w] = total.get(w, 0) + 1
                count[s][w] = count[s].get(w, 0) + 1
        kept = sorted(w for w in df if df[w] >= least)

        def shares(c):
            n = sum(c.get(w, 0) for w in kept)
            return {w: 1 + 10**9 * (c.get(w, 0) + 1) // (n + len(kept)) for w in kept}

        share, all_ = {s: shares(c) for s, c in count.items()}, shares(total)
        f = lambda p, q: (p - q) ** 2 // q
        for s in share:
            pairs = [(o, sum(f(share[s][w], share[o][w]) for w in kept)) for o in share if o != s]
            terms = [(w, f(share[s][w], all_[w])) for w in kept if count[s].get(w) and share[s][w] > all_[w]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)}
    return out


def held(docs, **options):
    got = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in source_audit.divergences(docs, **options).collect()]
    rows = [(r.lang, r.source, r.text) for r in docs.select("lang", "source", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, **options)
    return got


def test_small_table(spark):
    assert held(table(spark, "documents"))
    held(table(spark, "documents"), least=1, top=3)


def test_edges(spark):
    held(edge_docs(spark))
    held(edge_docs(spark), least=1)
    assert source_audit.divergences(empty_docs(spark)).count() == 0
    rows = [("en", s, t) for t in EDGE_TEXTS for s in ("a", "b", None)] + [(None, "a", "one two"), ("", None, "one One ONE"), ("xx", "only", None), ("xx", "other", "1 2 3")]
    held(spark.createDataFrame(rows, "lang string, source string, text string"))


def test_copies_count_with_their_multiplicity(spark):
    copied = [("en", f"s{i % 3}", "alpha beta beta") for i in range(400)] + [("de", "s1", "alpha beta beta")] * 5
    own = [("en", f"s{i % 4}", f"alpha w{chr(97 + i % 20)} own") for i in range(100)]
    held(spark.createDataFrame(copied + own, "lang string, source string, text string").repartition(9))


def test_many_blocks_and_small_memory(spark, monkeypatch):
    """Blocks, chunks and remembered texts of a few rows give the same sums."""
    monkeypatch.setattr(source_audit, "BLOCK_ENTRIES", 50)
    monkeypatch.setattr(source_audit, "REMEMBERED", 3)
    monkeypatch.setattr(source_audit, "CHUNK", 2000)
    held(table(spark, "documents").where("lang <> 'en'"))


def test_a_text_is_tokenised_once(spark, monkeypatch):
    rows = [("en", f"s{i % 5}", f"text number {chr(97 + i % 7)}") for i in range(700)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(6)
    sent = docs.mapInArrow(source_audit._collapse, source_audit.COLLAPSED)
    assert sent.where("text is not null").count() <= 6 * 7
    assert sent.groupBy("text_key").agg({"n": "sum"}).count() == 7
    held(docs)


def test_shares_are_exact():
    r = random.Random(5)
    for _ in range(2000):
        total = r.randrange(2, 9 * 10**15)
        count = r.randrange(0, total)
        assert int(source_audit.shares(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * (count + 1) // total


def test_share_sql_equals_python(spark):
    rows = [(c, t) for t in (2, 3, 1000, 8_999_999_999_999_999) for c in (0, 1, t // 2, t - 1)]
    got = spark.createDataFrame(rows, "c long, t long").selectExpr("c", "t", f"{source_audit._share('c', 't')} AS p").collect()
    assert all(x.p == 1 + 10**9 * (x.c + 1) // x.t for x in got)


def test_query(spark):
    assert source_audit.op12_source_divergence(spark, SMALL).columns == ["lang", "source", "part", "item", "value", "rank"]
