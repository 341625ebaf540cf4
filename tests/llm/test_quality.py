import re

from ledgerlens.llm import quality
from tests.llm.helpers import SMALL, SPACE_WORDS, docs_of, edge_docs, empty_docs, table


def plain(text):
    text = text or ""
    words = SPACE_WORDS.findall(text)
    lines = [x for x in text.split("\n") if SPACE_WORDS.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    n, repeats = len(words), len(covered)
    failed = n < 20 or 100 * repeats > 30 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, repeats, failed


def held(df, docs):
    rows = sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    for r, (d, text) in zip(rows, sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        assert (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (d, *plain(text))
        assert not (r.base_failed and r.kept) and 0 <= r.good <= 1
    return rows


def test_small_table_and_labels(spark):
    rows = held(quality.op3_quality(spark, SMALL), docs_of(table(spark, "documents")))
    good = {r.doc_id: r.quality for r in table(spark, "labels").collect()}
    right = [r.kept == bool(good[r.doc_id]) for r in rows if r.doc_id in good]
    assert sum(right) >= 0.9 * len(right)


def test_edges(spark):
    docs = edge_docs(spark)
    held(quality.judge(docs), docs_of(docs))
    lines = "x y\n\nx y\n \nx y\r\nlast\nlast"
    overlapping = "a b c d e f g h i a b c d e f g h i z"
    cases = [(0, lines), (1, overlapping), (2, "r " * 30), (3, "a b c d e f g h " * 2 + "q a b c d e f g h"), (4, "ab c d e f g h i a bc d e f g h i")]
    held(quality.judge(spark.createDataFrame(cases, "doc_id long, text string")), cases)
    assert quality.judge(empty_docs(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = quality.measures(table(spark, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_accuracies_are_recovered():
    """Votes drawn from known accuracies: the learned weights rank the rules as they are."""
    import random
    r, counts = random.Random(6), {}
    for _ in range(4000):
        y = 1 if r.random() < 0.7 else -1
        votes = tuple(0 if r.random() < 0.2 else (y if r.random() < a else -y) for a in (0.95, 0.85, 0.7, 0.6))
        counts[votes] = counts.get(votes, 0) + 1
    odds, weights = quality.learn(sorted(counts.items()))
    assert weights[0][1] > weights[1][1] > weights[2][1] > weights[3][1] > 0
    assert 0.6 < 1 / (1 + 2.718281828 ** -odds) < 0.8
    assert quality.learn([]) == (0.0, [])
