"""How document filters interact: what each removes after the others, in every order.

Every document is reduced to its part, which of the filters it fails, and its
labels; what differs between two orders of the filters depends on these alone.
Counted per part, they make a 2x2x2x2x2 tensor (an axis for each filter, 0 passes,
1 fails) of documents, of good and of toxic ones.  A step of an order is a
contraction of that tensor: along each axis a vector selects those that pass, those
that fail, or all.  One einsum contracts all steps of all orders of a part.

A, B, C and D look at the text alone.  E fails a text that is identical to that of
any smaller doc_id; identity is that of a 128-bit hash of the text.

Defined results: a null text counts as an empty one and a null part as ''; a null
doc_id is not larger than any, so it never fails E, and it has no labels; rows that
repeat one doc_id and text count each, none larger than the other; several labels of
one document count as good (toxic) if one is; very long texts are taken whole; an
empty table has no parts and gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm.tables import corpus_table, written
from ledgerlens.llm.words import separator_table, text_buffer, text_chunks, word_hashes, word_spans

FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT = 80     # per cent of the words
MOST_CAPITALS = 10      # per cent of the code points
SYMBOLS = b"#$%&*|"
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
STEP_SCHEMA = ("part string, filter_order string, step int, filter string, kept long, removed long, redundant long, "
               "unique_fails long, good_lost long, toxic_lost long, shapley long")


def _per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are marked."""
    return np.diff(np.concatenate([[0], np.cumsum(marks)])[offsets])


def text_failures(column) -> np.ndarray:
    """Which of A, B, C and D each text fails, as bits 1, 2, 4 and 8."""
    data, offsets = text_buffer(column)
    starts, ends, first = word_spans(data, offsets, separator_table("space"))
    hashes, n = word_hashes(data, starts, ends), np.diff(first)
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(first[:-1], first[1:])], np.int64)
    capitals = _per_text((data >= 0x41) & (data <= 0x5A), offsets)
    symbols = _per_text(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)), offsets)
    points = _per_text((data & 0xC0) != 0x80, offsets)
    failed = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * points, symbols > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(failed))


def _reduced(batches):
    for chunk in text_chunks(batches, "text"):
        data, offsets = text_buffer(chunk.column("text"))
        keys = [hashlib.blake2b(data[a:b].tobytes(), digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [chunk.column("doc_id"), chunk.column("part"), pa.array(keys, pa.binary()), pa.array(text_failures(chunk.column("text")), pa.int32())],
            names=["doc_id", "part", "text_key", "fails"])


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part and set of failed filters (bits, A first): documents, good and toxic ones."""
    slim = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
                   .mapInArrow(_reduced, "doc_id long, part string, text_key binary, fails int"), "failures")
    first = slim.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))
    marked = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")))
    # the smallest id of each text passes E; a key of the join is one document, however many copies its text has
    known = slim.where("doc_id is not null").join(first.withColumn("first", F.lit(0)), ["text_key", "doc_id"], "left").join(marked, "doc_id", "left")
    each = known.select("part", F.col("fails").bitwiseOR(F.coalesce("first", F.lit(16))).alias("fails"), "good", "toxic").unionByName(
        slim.where("doc_id is null").select("part", "fails", F.lit(False).alias("good"), F.lit(False).alias("toxic")))
    return each.groupBy("part", "fails").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def contract(tensors: np.ndarray, filters: str = FILTERS) -> list[dict]:
    """Every step of every order of the filters, from the tensors (documents, good, toxic; an axis for each filter)."""
    orders = list(permutations(range(len(filters))))
    steps = [(order, k) for order in orders for k in range(len(order))]
    axes = "abcdefgh"[:len(filters)]

    def contracted(selected: list[list[tuple[int, int]]]) -> np.ndarray:
        vectors = np.array(selected, np.int64)          # rows x axes x (pass, fail)
        operands = [vectors[:, axis, :] for axis in range(len(filters))]
        return np.einsum(f"z{axes}," + ",".join(f"n{a}" for a in axes) + "->zn", tensors, *operands)

    def choice(passed, failed, rest=ALL):
        return [FAIL if axis == failed else PASS if axis in passed else rest for axis in range(len(filters))]

    kept = contracted([choice(order[:k + 1], None) for order, k in steps])[0]
    removed, good, toxic = contracted([choice(order[:k], order[k]) for order, k in steps])
    fails = contracted([choice((), own) for own in range(len(filters))])[0]
    only = contracted([choice((), own, PASS) for own in range(len(filters))])[0]
    shapley = [sum(int(r) for r, (order, k) in zip(removed, steps) if order[k] == own) for own in range(len(filters))]
    return [{"filter_order": "".join(filters[f] for f in order), "step": k + 1, "filter": filters[order[k]], "kept": int(kept[i]),
             "removed": int(removed[i]), "redundant": int(fails[order[k]] - removed[i]), "unique_fails": int(only[order[k]]),
             "good_lost": int(good[i]), "toxic_lost": int(toxic[i]), "shapley": shapley[order[k]]} for i, (order, k) in enumerate(steps)]


def _contracted(batches):
    for batch in batches:
        for row in batch.to_pylist():
            tensors = np.zeros((3, 1 << len(FILTERS)), np.int64)
            for cell in row["cells"]:
                tensors[:, cell["fails"]] = cell["n"], cell["good"], cell["toxic"]
            # bit k of a cell is axis k, so the first axis varies fastest
            tensors = tensors.reshape(3, *[2] * len(FILTERS)).transpose(0, *range(len(FILTERS), 0, -1))
            steps = contract(tensors)
            yield pa.RecordBatch.from_pylist([{"part": row["part"], **step} for step in steps], schema=_steps())


def _steps() -> pa.Schema:
    long = [(name, pa.int64()) for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
    return pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), ("filter", pa.string()), *long])


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part (lang), order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    parts = failures(docs, labels).groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))     # 32 cells at most
    return parts.mapInArrow(_contracted, STEP_SCHEMA)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(corpus_table(spark, sf_dir, "documents", "doc_id", "text", "lang"),
                        corpus_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
