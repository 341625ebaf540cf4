import hashlib
import random
import re

import numpy as np

from ledgerlens.llm import secret_scan as ss
from tests.llm.helpers import SMALL, docs_of, edge_docs, empty_docs, table

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def held(df, docs):
    rows = sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    for r, (d, text) in zip(rows, sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        want = plain(text)
        joined = ",".join(f"{ss.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert (r.doc_id, r.n_assign, r.n_access, r.n_hex) == (d, *(sum(w[1] == k for w in want) for k in range(3)))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    return rows


def test_small_table(spark):
    held(ss.op9_secrets(spark, SMALL), docs_of(table(spark, "documents")))


CASES = ["password=abcdef1", "Token : 'abc'", "secret=token:abcdefgh", "APIKEY=\"zzzzzz", "api_key=12345", "x" * 30 + "0" * 24,
         "AKIA" + "A" * 15, "AKIA" + "A" * 16 + "é password = ünï", "deadbeef" * 3 + "é" + "0" * 23, "paſſword=abcdefgh", "toKen=abcdefgh"]


def test_edges(spark):
    docs = edge_docs(spark)
    held(ss.find_secrets(docs), docs_of(docs))
    cases = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    held(ss.find_secrets(cases), list(enumerate(CASES)))
    assert ss.find_secrets(empty_docs(spark)).count() == 0


def test_hex_of_decimal_digits_only(spark):
    cases = list(enumerate(["order 123456789012345678901234 done", "0" * 23, "x " + "7" * 24, "9" * 12, "9" * 12, None, "é" + "1" * 30]))
    docs = spark.createDataFrame(cases, "doc_id long, text string")
    assert [r.n_hex for r in held(ss.find_secrets(docs), cases)] == [1, 0, 1, 0, 0, 0, 1]
    assert ss.without_secrets(docs).where("doc_id = 0").first().text == "order [SECRET] done"


def natural(r, n):
    return "".join(r.choice(["th", "er", "in", "an", "re", "on", "es", "ti"]) for _ in range(n))


def test_random_strings_are_told_from_words(spark):
    r = random.Random(3)
    alphabet = ss.ENCODINGS[5]
    hidden = ["".join(r.choice(alphabet) for _ in range(40)) for _ in range(60)]
    rows = [(i, f"{natural(r, 9)} {natural(r, 10)} {h} {natural(r, 12)}2024 {natural(r, 20)}") for i, h in enumerate(hidden)]
    rows += [(1000 + i, f"{natural(r, 9)} {natural(r, 14)}-{natural(r, 8)}7 {natural(r, 20)}") for i in range(600)]
    out = {x.doc_id: x.spans for x in ss.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(f"random:{t.index(h)}:{t.index(h) + 40}" in out[i] for (i, t), h in zip(rows, hidden))
    assert found >= 55
    assert sum(bool(out[i]) for i, _ in rows[60:]) <= 6


def test_runs_of_mixed_separators_are_cut(spark):
    r = random.Random(5)
    keys = ["".join(r.choice(ss.ENCODINGS[5]) for _ in range(40)) for _ in range(60)]
    safe = ["".join(r.choice(ss.ENCODINGS[7]) for _ in range(46)) for _ in range(60)]
    rows = [(i, f"{natural(r, 9)} my-app/{k} {natural(r, 20)}") for i, k in enumerate(keys)]
    rows += [(100 + i, f"{natural(r, 9)} v1/the_app/{k}/x {natural(r, 20)}") for i, k in enumerate(safe)]
    rows += [(1000 + i, f"{natural(r, 9)} {natural(r, 14)}-{natural(r, 8)}7/{natural(r, 9)} {natural(r, 20)}") for i in range(600)]
    rows += [(5000, "cdn/my-app/0123456789abcdef0123456789abcdef")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x.doc_id: x.spans for x in held(ss.find_secrets(docs), rows)}
    text = dict(rows)

    def covered(d, key):
        spans = [s.split(":") for s in out[d].split(",") if s]
        at = text[d].index(key)
        return any(k == "random" and int(a) <= at and at + len(key) <= int(b) for k, a, b in spans)

    assert sum(covered(i, k) for i, k in enumerate(keys)) >= 55
    assert sum(covered(100 + i, k) for i, k in enumerate(safe)) >= 55
    assert sum(bool(out[1000 + i]) for i in range(600)) <= 6
    assert out[5000] == "hex:11:43"
    for spans in out.values():      # random ones do not overlap
        ends = [tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s.startswith("random")]
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_battery():
    r = np.random.default_rng(2)
    uniform = [ss.randomness(r.integers(0, 62, 40), 62) for _ in range(400)]
    assert 4 < np.mean(uniform) < 8 and np.mean(np.array(uniform) > ss.RANDOM_AT_MOST) < 0.02
    assert ss.randomness(np.arange(40) % 62, 62) > 30 and ss.randomness(np.zeros(40, int), 62) > 60


def test_masking_keeps_everything_else(spark):
    docs = spark.createDataFrame([(1, "a password=abcdef1 b", "en", 20), (2, None, "de", None), (3, "clean text", "fr", 10), (None, "token: zzzzzzzz", None, 1)],
                                 "doc_id long, text string, lang string, n_chars long")
    out = {r.doc_id: (r.text, r.lang, r.n_chars) for r in ss.without_secrets(docs).collect()}
    assert out == {1: ("a [SECRET] b", "en", 12), 2: (None, "de", None), 3: ("clean text", "fr", 10), None: ("[SECRET]", None, 8)}
    assert ss.masked("abcdef", [(0, 0, 3), (2, 2, 4)]) == "[SECRET]ef"
