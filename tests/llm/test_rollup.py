from collections import defaultdict

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import rollup
from ledgerlens.llm.tables import shared_folder
from tests.llm.helpers import SMALL, SPACE_WORDS, edge_docs, empty_docs, table

LIBRARY = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
COUNTS = {"words": lambda t: len(SPACE_WORDS.findall(t)), "byte_bpe_50k": lambda t: len(LIBRARY.encode(t, add_special_tokens=False).ids)}


def plain(rows):
    first = {}
    for r in rows:
        t = r.text or ""
        if r.doc_id is not None:
            first[t] = min(r.doc_id, first.get(t, r.doc_id))
    out = defaultdict(lambda: [0, 0])
    for r in rows:
        if first.get(r.text or "") != r.doc_id:
            continue
        text = "\n".join(dict.fromkeys((r.text or "").split("\n")))
        for version, count in COUNTS.items():
            own = out[r.source, r.lang, version]
            own[0] += 1
            own[1] += count(text)
    return {(*k, *v) for k, v in out.items()}


def test_small_table(spark):
    got = {tuple(r) for r in rollup.op6_token_rollup(spark, SMALL).collect()}
    assert got == plain(table(spark, "documents").collect())


def test_batches_are_signed_and_idempotent(spark):
    counts = rollup.count_tokens(edge_docs(spark))
    r = rollup.Rollup(spark, shared_folder(spark, "rollup-test"))
    r.commit("load", inserted=counts)
    once = sorted(map(tuple, r.totals().collect()), key=str)
    r.commit("load", inserted=counts)
    assert sorted(map(tuple, r.totals().collect()), key=str) == once
    assert sum(t[3] for t in once) == 2 * edge_docs(spark).count()
    part = counts.where("doc_id = 5")
    r.commit("gone", removed=part)
    r.commit("back", inserted=part)
    assert sorted(map(tuple, r.totals().collect()), key=str) == once
    r.commit("all-gone", removed=counts)
    assert r.totals().count() == 0


def test_a_commit_that_is_cut_off_leaves_the_old_totals(spark, monkeypatch):
    counts = rollup.count_tokens(edge_docs(spark))
    folder = shared_folder(spark, "rollup-cut")
    r = rollup.Rollup(spark, folder)
    assert r.totals().count() == 0
    r.commit("load", inserted=counts)
    once = sorted(map(tuple, r.totals().collect()), key=str)

    def dies(*_):
        raise RuntimeError("the driver is lost")

    with monkeypatch.context() as m:
        m.setattr(rollup.Rollup, "_mark", dies)
        for batch in ("load", "more"):
            with pytest.raises(RuntimeError):
                r.commit(batch, inserted=counts.where("doc_id = 5"))
    again = rollup.Rollup(spark, folder)
    assert sorted(map(tuple, again.totals().collect()), key=str) == once
    again.commit("load", inserted=counts.where("doc_id = 5"))
    assert sum(t.documents for t in again.totals().collect()) == 2 * edge_docs(spark).where("doc_id = 5").count()


def test_counts_of_edge_texts(spark):
    for r in rollup.count_tokens(edge_docs(spark)).join(edge_docs(spark).select("doc_id", "text").distinct(), "doc_id").collect():
        assert r.tokens == COUNTS[r.version](r.text or "")


def test_empty(spark):
    r = rollup.Rollup(spark, shared_folder(spark, "rollup-empty"))
    r.commit("load", inserted=rollup.count_tokens(empty_docs(spark)))
    assert r.totals().count() == 0
