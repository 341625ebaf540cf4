import corpus_pipeline as cp
from pyspark.sql import functions as F

from ledgerlens.llm import toxicity as tox
from tests.llm.helpers import SMALL, docs_of, edge_docs, empty_docs, table
from tests.llm.test_decontaminate import plain as plain_contamination
from tests.llm.test_neardup import plain as plain_groups
from tests.llm.test_packing import check_pieces, check_sequences
from tests.llm.test_secrets import plain as plain_secrets


def test_every_stage_against_brute_force(spark):
    docs = table(spark, "documents")
    columns = docs.columns
    kept = cp.toxicity(spark, docs, SMALL)
    scores = {r.doc_id: r.predicted for r in tox.score_documents(docs, tox.fit_tables(spark, SMALL)).collect()}
    assert kept.columns == columns
    assert {r.doc_id for r in kept.collect()} == {d for d, p in scores.items() if not p}

    before = docs_of(kept)
    kept = cp.near_dedup(spark, kept, SMALL)
    assert kept.columns == columns and {d for d, _ in docs_of(kept)} == {g[0] for g in plain_groups(before, 5) if g[3]}

    before = docs_of(kept)
    items = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    kept = cp.decontaminate(spark, kept, SMALL)
    assert kept.columns == columns and {d for d, _ in docs_of(kept)} == {c[0] for c in plain_contamination(before, items) if not c[5]}

    before = dict(docs_of(kept))
    masked = cp.secrets(spark, kept, SMALL)
    assert masked.columns == columns
    after = {r.doc_id: r for r in masked.collect()}
    assert set(after) == set(before)
    for d, text in before.items():
        found = plain_secrets(text)
        assert (after[d].text != text) >= bool(found) and after[d].n_chars == len(after[d].text)
        assert not any(text[a:b] in after[d].text for a, _, b in found)

    rows = cp.packing(spark, masked, SMALL).collect()
    check_pieces(rows, [(d, r.text) for d, r in after.items()])
    check_sequences(rows)


def test_run_gives_the_last_stage(spark):
    rows = cp.run(spark, SMALL)
    assert {"doc_id", "piece", "sequence_id"} <= set(rows.columns) and rows.count() > 0
    assert len(cp.STAGES) == 5 and [n for n, _ in cp.STAGES][1] == "near_dedup"


def test_edges(spark):
    for make in (edge_docs, empty_docs):
        docs = make(spark)
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == make(spark).columns
        pieces = cp.packing(spark, docs, SMALL)
        assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert edge_docs(spark).where(F.col("doc_id").isNull()).count() == 1
