import random
from itertools import permutations

import numpy as np

from ledgerlens.llm import filter_audit
from tests.llm.helpers import SMALL, SPACE_WORDS, docs_of, edge_docs, empty_docs, table


def plain_fails(rows):
    """Per (doc_id, text, ...): the filters it fails, by their definition."""
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    for doc_id, text, *_ in rows:
        text = text or ""
        words = SPACE_WORDS.findall(text)
        yield "".join(name for name, fails in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            any(c in "#$%&*|" for c in text), doc_id is not None and doc_id > first[text])) if fails)


def plain(rows, labels):
    """Every order applied to the rows one filter after the other."""
    good = {d for d, q, t in labels if q == 1 and d is not None}
    toxic = {d for d, q, t in labels if t == 1 and d is not None}
    known = [(row[0], row[2] or "", fails) for row, fails in zip(rows, plain_fails(rows))]
    out, shapley = {}, {}
    for part in {p for _, p, _ in known}:
        own = [(d, fails) for d, p, fails in known if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, name in enumerate(order, 1):
                gone, left = [x for x in left if name in x[1]], [x for x in left if name not in x[1]]
                shapley[part, name] = shapley.get((part, name), 0) + len(gone)
                out[part, order, k] = (name, len(left), len(gone), sum(name in f for _, f in own) - len(gone), sum(f == name for _, f in own),
                                       sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone))
    return {key: (*value, shapley[key[0], value[0]]) for key, value in out.items()}


def held(docs, labels):
    got = filter_audit.interactions(docs, labels).collect()
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    want = plain(rows, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert len(got) == len(want)
    assert {(r.part, r.filter_order, r.step): (r.filter, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == want


def test_small_table(spark):
    held(table(spark, "documents"), table(spark, "labels"))
    assert filter_audit.op11_filter_audit(spark, SMALL).count() == 600 * 4


def test_edges(spark):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (5, 1, None), (None, 1, 1), (6, None, 1)], "doc_id long, quality int, toxic int")
    docs = edge_docs(spark)
    held(docs, labels)
    rows = [(3, "A", None), (7, "A", ""), (7, "B", "en"), (7, "B", "en"), (None, "A", "en"), (None, None, "en"), (1, "", "en"), (2, None, "en"),
            (8, "W x " * 60, "en"), (9, "ÄÖ " * 3 + "Z", "en"), (10, " ".join(map(str, range(150))), "en"), (11, "a|b", "en")]
    held(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels)
    assert filter_audit.interactions(empty_docs(spark), labels).count() == 0
    held(docs, labels.limit(0))


def test_one_text_of_a_third_of_the_rows(spark):
    rows = [(i, "copy # text" if i % 3 == 0 else f"own text {i} " * (i % 60), "en") for i in range(900)]
    held(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7), spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(900)], "doc_id long, quality int, toxic int"))


def test_contraction_of_three_filters():
    r = random.Random(3)
    tensors = np.array([[r.randrange(50) for _ in range(8)] for _ in range(3)], np.int64).reshape(3, 2, 2, 2)
    steps = {(s["filter_order"], s["step"]): s for s in filter_audit.contract(tensors, "ABC")}
    assert len(steps) == 18
    s = steps["BCA", 2]       # passed B, fails C, A is open
    assert (s["removed"], s["good_lost"], s["toxic_lost"]) == tuple(int(t[:, 0, 1].sum()) for t in tensors)
    assert s["kept"] == tensors[0][:, 0, 0].sum() and s["unique_fails"] == tensors[0][0, 0, 1]
    assert s["redundant"] == tensors[0][:, 1, 1].sum()
    assert sum(x["removed"] for k, x in steps.items() if k[0] == "CAB") == tensors[0].sum() - tensors[0][0, 0, 0]


def test_text_failures_equal_their_definition(spark):
    import pyarrow as pa
    texts = [t for _, t in docs_of(table(spark, "documents"))]
    got = filter_audit.text_failures(pa.array(texts, pa.string()))
    want = list(plain_fails([(None, t) for t in texts]))
    assert ["".join(n for k, n in enumerate("ABCD") if g >> k & 1) for g in got] == want
