import hashlib
import re

import numpy as np

from ledgerlens.llm import pii
from tests.llm.helpers import SMALL, docs_of, edge_docs, empty_docs, table


def plain(text):
    text = text or ""
    digits = lambda s: re.sub(r"[^0-9]", "", s)

    def luhn(s):
        own = [int(c) for c in s[::-1]]
        return (sum(own[::2]) + sum(sum(divmod(2 * d, 10)) for d in own[1::2])) % 10 == 0

    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(p) < 4000 and int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


def held(df, docs):
    rows = sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    for r, (d, text) in zip(rows, sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        want = plain(text)
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert (r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone) == (d, *(sum(w[0] == k for w in want) for k in range(4)))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        spans = [tuple(s.split(":")) for s in r.spans.split(",") if s]
        assert set(filter(None, joined.split(","))) <= {":".join(s) for s in spans}
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), int(s[1])))
    return rows


CASES = ["a.b+c@x-y.co.uk, a@b @c.d e@f..g", "1.2.3.4.5 256.1.1.1 01.002.03.4", "4111 1111 1111 1111 and 4111-1111-1111-1112",
         "+1 (988) 555-2485 +12 +1234567890123456", "é +49 30 1234567é x@y.zz", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "9" * 5000 + ".1.1.1",
         "0" * 400 + ".0.0.0", "²³ +1² 12345678"]


def test_small_table(spark):
    held(pii.op4_pii(spark, SMALL), docs_of(table(spark, "documents")))


def test_edges(spark):
    docs = edge_docs(spark)
    held(pii.find_personal_data(docs), docs_of(docs))
    cases = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    held(pii.find_personal_data(cases), list(enumerate(CASES)))
    assert pii.find_personal_data(empty_docs(spark)).count() == 0


def test_message_passing_is_exact_on_trees():
    r = np.random.default_rng(1)
    own = r.normal(size=(4, pii.LABELS))
    links = [(0, 1, r.normal(size=(pii.LABELS,) * 2)), (1, 2, r.normal(size=(pii.LABELS,) * 2)), (1, 3, r.normal(size=(pii.LABELS,) * 2))]
    total = np.zeros((4, pii.LABELS))
    for a in np.ndindex(*(pii.LABELS,) * 4):
        p = np.exp(sum(own[i, a[i]] for i in range(4)) + sum(w[a[i], a[j]] for i, j, w in links))
        for i in range(4):
            total[i, a[i]] += p
    total /= total.sum(axis=1, keepdims=True)
    assert np.allclose(pii.marginals(own, links, sweeps=80), total, atol=1e-6)


def test_repeats_take_their_label_along(spark):
    """A number recognised once is found where it stands without its sign; other numbers are left alone."""
    rows = [(i, f"call +1 (2{i % 90 + 10}) 555-{1000 + i} now and then pay 12 or 1999 there") for i in range(300)]
    rows += [(1000, "call +1 (212) 555-7788 now, or later (212) 555-7788 again"), (1001, "in 1999 we had 12 of 3400 parts")]
    out = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = rows[-2][1]
    assert out[1000].split(",")[0] == "phone:5:22"
    assert f"phone:{text.rindex('(212)')}:{text.rindex('7788') + 4}" in out[1000].split(",")
    assert out[1001] == "" and all("," not in out[i] for i in range(300))


def test_repeats_in_the_learning_texts_teach_no_wrong(spark):
    """Half the texts repeat their number without its sign, once to 40 times, anywhere: all are found, and nothing else."""
    import random
    r = random.Random(8)
    rows, want = [], {}
    for i in range(400):
        area, rest = f"(2{i % 90 + 10})", f"555-{1000 + i}"
        text = f"call +1 {area} {rest} now and then pay 12 or 1999 there in 2024-01-05"
        spans = []
        for k in range(i % 41 if i % 2 else 0):
            text += " " + " ".join(r.choice(("and", "so", "or", "17", "the", "3.5")) for _ in range(r.randrange(1, 30))) + " "
            spans.append(f"phone:{len(text)}:{len(text) + len(area) + 1 + len(rest)}")
            text += f"{area} {rest}"
        rows.append((i, text))
        want[i] = spans
    out = {x.doc_id: x.spans.split(",") for x in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        base = {f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in plain(text)}
        assert [s for s in out[i] if s not in base] == want[i]


def test_hidden_labels_and_links_to_the_first_recognised():
    _, tokens, nodes = pii.nodes_of("+15551234567 then 15551234567 and 777 777 15551234567 end 99 15551234567")
    labels = [3] + [pii.OTHER] * (len(nodes) - 1)
    assert pii.hidden_of(tokens, nodes, labels) == [False, True, False, False, True, False, True]
    near, skip = pii.links_of(tokens, nodes, labels)
    assert skip == [(0, 1), (1, 4), (0, 4), (4, 6), (0, 6)]


def test_links_are_linear():
    text = "x1234 " * 5000
    _, tokens, nodes = pii.nodes_of(text)
    near, skip = pii.links_of(tokens, nodes)
    assert len(near) == len(skip) == 4999
