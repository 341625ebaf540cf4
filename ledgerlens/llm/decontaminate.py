"""Benchmark decontamination with a distributed positional inverted index.

The corpus is cut into blocks of documents; each block stores, for every term,
the sorted places where it stands (`build_index`, a written table with a row per
block).  A set of test phrases is then looked up block by block: each phrase
starts from the block's postings of its rarest term, shifted to where the phrase
would begin, and is intersected with the postings of its next rarest terms until
it is refuted or complete (`find_phrases`).  `slop` > 0 lets every term stand up
to that many words off its place (proximity instead of exact phrases).

Memory is bounded by the block and by `PHRASES_PER_PASS`; a larger test set takes
more passes over the stored index.

Defined results: a null or empty text has no words and no hits, an item without
words is never found, an item shorter than the window is one phrase; a document is a
row, so rows with one id, or none, have each their own hits; equal item ids count
once; an item with a null id hits but is not among the items counted or hashed.  Very
long texts are taken whole.  Empty tables give empty results; other columns of the
tables are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm.tables import corpus_table, matched, text_key, written
from ledgerlens.llm.words import hashed_words, text_chunks

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: Test phrases sent to the executors at once: 200,000 of 10 words are 18 MB.
PHRASES_PER_PASS = 200_000

INDEX_SCHEMA = "doc_ids array<long>, n_words binary, terms binary, counts binary, places binary, text_keys array<binary>"
#: A hit's document is the `at`-th of its `block`.
HIT_SCHEMA = "block long, at int, doc_id long, item_id string, start long, length long"


def _index_blocks(batches):
    for chunk in text_chunks(batches, "text", BLOCK_BYTES):
        words, first = hashed_words(chunk.column("text"), "alnum")
        order = np.argsort(words, kind="stable").astype(np.uint32)
        terms, counts = np.unique(words, return_counts=True)
        ids = pa.ListArray.from_arrays(pa.array([0, chunk.num_rows], pa.int32()), chunk.column("doc_id"))
        keys = pa.ListArray.from_arrays(pa.array([0, chunk.num_rows], pa.int32()), chunk.column("text_key"))
        row = [np.diff(first).astype(np.uint32), terms, counts.astype(np.uint32), order]
        yield pa.RecordBatch.from_arrays([ids, *(pa.array([x.tobytes()], pa.binary()) for x in row), keys],
                                         names=["doc_ids", "n_words", "terms", "counts", "places", "text_keys"])


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of (doc_id, text): a row per block, with its number and postings."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key"))
    return written(docs.mapInArrow(_index_blocks, INDEX_SCHEMA).withColumn("block", F.monotonically_increasing_id()), "postings")


def phrases_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, terms): every run of `window` words of each item, or all its words if it has fewer."""
    def cut(batches):
        for chunk in text_chunks(batches, "text"):
            words, first = hashed_words(chunk.column("text"), "alnum")
            ids, out = chunk.column("item_id").to_pylist(), []
            for item, a, b in zip(ids, first[:-1], first[1:]):
                if b > a:
                    n = min(window, b - a)
                    out += [(item, words[i:i + n].tobytes()) for i in range(a, b - n + 1)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()),
                                                  pa.array([x[1] for x in out], pa.binary())], names=["item_id", "terms"])

    return (items.select(F.col("item_id").cast("string").alias("item_id"), "text")
            .mapInArrow(cut, "item_id string, terms binary").distinct())


def _match(terms, counts, places, first, phrases, lengths, slop):
    """(phrase, start) of every occurrence in one block; `phrases` is a matrix padded on the right."""
    if not len(terms) or not len(phrases):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    rank = np.minimum(np.searchsorted(terms, phrases), len(terms) - 1)
    used = np.arange(phrases.shape[1]) < lengths[:, None]
    found = (terms[rank] == phrases) | ~used
    live = np.flatnonzero(found.all(axis=1))
    if not len(live):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank, used, lengths = rank[live], used[live], lengths[live]
    df = np.where(used, counts[rank], np.iinfo(np.uint32).max).astype(np.int64)
    rarest = np.argsort(df, axis=1, kind="stable")
    # postings of each phrase's rarest term, shifted to the start of the phrase
    head = rank[np.arange(len(live)), rarest[:, 0]]
    size = counts[head].astype(np.int64)
    who = np.repeat(np.arange(len(live)), size)
    within = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size)
    anchor = places[begin[head][who] + within].astype(np.int64)
    start = anchor - rarest[who, 0]
    document = np.searchsorted(first, anchor, side="right") - 1
    keep = (start >= first[document] - slop) & (start + lengths[who] <= first[document + 1] + slop)
    who, start, document = who[keep], start[keep], document[keep]
    key = (np.repeat(np.arange(len(terms)), counts).astype(np.int64) << 32) | places  # sorted: postings by term, place
    for k in range(1, phrases.shape[1]):
        if not len(who):
            break
        column = rarest[who, k]
        needed = column < lengths[who]
        low = np.maximum(start + column - slop, first[document])
        high = np.minimum(start + column + slop, first[document + 1] - 1)
        base = rank[who, column].astype(np.int64) << 32
        at = np.minimum(np.searchsorted(key, base | np.maximum(low, 0)), len(key) - 1)
        ok = ~needed | ((key[at] >= base | low) & (key[at] <= base | np.maximum(high, 0)) & (low <= high))
        who, start, document = who[ok], start[ok], document[ok]
    return live[who], start


def find_phrases(index: DataFrame, phrases: list[tuple[str, bytes]], slop: int = 0) -> DataFrame:
    """(block, at, doc_id, item_id, start, length) of every occurrence of the given (item_id, terms) in the index."""
    lengths = np.array([len(p[1]) // 8 for p in phrases], dtype=np.int64)
    matrix = np.zeros((len(phrases), int(lengths.max(initial=1))), dtype=np.uint64)
    for i, (_, terms) in enumerate(phrases):
        matrix[i, :lengths[i]] = np.frombuffer(terms, np.uint64)
    sent = index.sparkSession.sparkContext.broadcast((matrix, lengths, np.array([p[0] for p in phrases], dtype=object)))

    def look_up(batches):
        matrix, lengths, items = sent.value
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column(0)[r].values
                n, terms, counts, places = (np.frombuffer(batch.column(k)[r].as_py(), t)
                                            for k, t in enumerate((np.uint32, np.uint64, np.uint32, np.uint32), 1))
                first = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
                who, start = _match(terms, counts, places, first, matrix, lengths, slop)
                if len(who):
                    # a match may begin before its document under slop: its middle lies inside
                    middle = np.clip(start + lengths[who] // 2, 0, first[-1] - 1)
                    document = np.searchsorted(first, middle, side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(batch.column(5)[r], len(who)), pa.array(document.astype(np.int32)), ids.take(pa.array(document)),
                         pa.array(items[who], pa.string()), pa.array(start - first[document]), pa.array(lengths[who])],
                        names=["block", "at", "doc_id", "item_id", "start", "length"])

    return index.drop("text_keys").mapInArrow(look_up, HIT_SCHEMA)


def occurrences(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """All occurrences of all items' windows, in passes of at most `PHRASES_PER_PASS` phrases."""
    phrases, found, batch = written(phrases_of(items, window), "phrases"), None, []
    for row in phrases.toLocalIterator():
        batch.append((row.item_id, bytes(row.terms)))
        if len(batch) == PHRASES_PER_PASS:
            hits = written(find_phrases(index, batch, slop), "hits")
            found, batch = hits if found is None else found.unionByName(hits), []
    hits = find_phrases(index, batch, slop)
    return hits if found is None else found.unionByName(hits)


def document_lengths(index: DataFrame) -> DataFrame:
    """(block, at, doc_id, text_key, n_words) of every indexed document."""
    def unpack(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column(1)[r].values
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(batch.column(0)[r], len(ids)), pa.array(np.arange(len(ids), dtype=np.int32)), ids, batch.column(2)[r].values,
                     pa.array(np.frombuffer(batch.column(3)[r].as_py(), np.uint32).astype(np.int64))],
                    names=["block", "at", "doc_id", "text_key", "n_words"])

    return index.select("block", "doc_ids", "text_keys", "n_words").mapInArrow(unpack, "block long, at int, doc_id long, text_key binary, n_words long")


def hit_documents(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(block, at, n_hit, items) of the documents with an occurrence of an item's window."""
    hits = occurrences(index, items, window)
    return (hits.select("block", "at", "item_id", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("place"))
            .groupBy("block", "at").agg(F.countDistinct("place").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items")))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit (words inside an occurrence), n_items, items_sha256, contaminated."""
    index = build_index(docs)
    none = F.array().cast("array<string>")
    return (document_lengths(index).join(hit_documents(index, items, window), ["block", "at"], "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns, without an occurrence of an item's window."""
    index = build_index(docs)
    hit = hit_documents(index, items, window).select("block", "at")
    found = document_lengths(index).join(hit, ["block", "at"], "left_semi").select("doc_id", "text_key").distinct()
    return matched(docs, written(found, "contaminated"), "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(corpus_table(spark, sf_dir, "documents", "doc_id", "text"),
                         corpus_table(spark, sf_dir, "benchmark", "item_id", "text"))
