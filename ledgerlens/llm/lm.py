"""Language-model scores by deleted interpolation.

The probability of a token mixes the maximum-likelihood estimates of all orders
(uniform, 1-gram, ... n-gram).  The mixture weights depend on the longest context
seen in training and on the bucket of its frequency (powers of two), and are
learned by expectation-maximisation: one training fold is deleted from the
counts, and the weights that make this fold likeliest under the other folds'
counts are taken.  Scoring then uses the counts of all training folds.

N-gram counts grow with the corpus and are never gathered: documents stand in
blocks of bounded size; each block sends its sorted distinct n-gram hashes (64
bits, as differences) with its counts to range partitions of the hash space, and
gets back the corpus totals in the same order.  Every n-gram travels once per
block, so a frequent one costs no more than a rare one.  The only data at the
driver are the totals of tokens and words and the expectation-maximisation's
table, whose size is bounded by buckets and `STEPS` probability steps an octave.

Defined results: null and empty texts are one end token; with no training text
the words are unknown and the uniform estimate is 1; repeated rows count each
time; a document with a null doc_id is a training document; empty tables give
empty results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm.tables import corpus_table, written
from ledgerlens.llm.words import hashed_words, mix, text_buffer, text_chunks

ORDER = 2
HELD_OUT, DELETED, KEPT = 0, 1, 2     # folds: scored only, deleted for the weights, the rest of training
BLOCK_BYTES = 6 << 20
PART_BYTES = 4 << 20
BUCKETS, STEPS, OCTAVES = 40, 4, 48
ROUNDS = 60
BEGIN, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x2545F4914F6CDD1D)

BLOCK_SCHEMA = "block long, fold int, size long, doc_ids array<long>, lengths binary, texts binary"
GRAM_SCHEMA = "part int, block long, fold int, kind int, keys binary, counts binary"
TOTAL_SCHEMA = ("part int, block long, fold int, kind int, totals binary, others binary, "
                "n long, v long, n_others long, v_others long")
SCORE_SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                "base_score double, score double")


def _planes(values: np.ndarray) -> bytes:
    """The bytes of all values by significance: the high ones are mostly 0 and compress away."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _from_planes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _to_blocks(batches):
    import zstandard
    from pyspark import TaskContext
    pack, block = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
    for chunk in text_chunks(batches, "text", BLOCK_BYTES):
        folds = np.asarray(chunk.column("fold"))
        for fold in (HELD_OUT, DELETED, KEPT):
            part = chunk.filter(pa.array(folds == fold))
            if part.num_rows:
                data, offsets = text_buffer(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([fold], pa.int32()), pa.array([len(data)]),
                     pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                     pa.array([np.diff(offsets).tobytes()], pa.binary()),
                     pa.array([pack.compress(data.tobytes())], pa.binary())],
                    names=["block", "fold", "size", "doc_ids", "lengths", "texts"])
                block += 1


class Grams:
    """The n-grams of a block's documents, each a sequence of words with an end token."""

    def __init__(self, lengths: bytes, texts: bytes, order: int):
        import zstandard
        data = zstandard.ZstdDecompressor().decompress(texts)
        offsets = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, np.int64))]).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        words, first = hashed_words(column, "space")
        n = np.diff(first)
        size = n + order
        base = np.cumsum(size) - size
        self.order, self.tokens = order, n + 1
        self.sequence = np.full(int(size.sum()), BEGIN, np.uint64)
        self.sequence[base + size - 1] = END
        self.sequence[np.arange(len(words)) + np.repeat(base + order - 1 - first[:-1], n)] = words
        real = np.ones(len(self.sequence), bool)
        for j in range(order - 1):
            real[base + j] = False
        self.at = np.flatnonzero(real)
        self.before = base + order - 2

    def keys(self, k: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the k-grams that end at the given places."""
        h = mix(self.sequence[at - k + 1] + np.uint64(k))
        for j in range(k - 2, -1, -1):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + self.sequence[at - j])
        return h

    def distinct(self, k: int):
        """(sorted distinct keys, index of each place, places): all tokens, then the begin of each text as a context."""
        at = np.concatenate([self.at, self.before]) if k < self.order else self.at
        keys, index = np.unique(self.keys(k, at), return_inverse=True)
        return keys, index, at


def _begin_key() -> np.uint64:
    return mix(np.array([BEGIN]) + np.uint64(1))[0]


def _send_grams(order: int, bits: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                grams, out = Grams(row["lengths"], row["texts"], order), []
                for k in range(1, order + 1):
                    keys, index, _ = grams.distinct(k)
                    counts = np.bincount(index, minlength=len(keys)).astype(np.uint32)
                    part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                    used, cuts = np.unique(part, return_index=True)
                    for p, a, b in zip(used, cuts, [*cuts[1:], len(keys)]):
                        own = slice(a, b)
                        steps = np.diff(keys[own], prepend=np.uint64(0))
                        out.append((int(p), row["block"], row["fold"], k, _planes(steps),
                                    b"" if row["fold"] == HELD_OUT else _planes(counts[own])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                    names=["part", "block", "fold", "kind", "keys", "counts"])

    return run


_TOTAL_TYPES = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
_TOTAL_NAMES = ["part", "block", "fold", "kind", "totals", "others", "n", "v", "n_others", "v_others"]


def _sum_part(table: pa.Table) -> pa.Table:
    """Totals of one range of hashes, returned to each block in the order of its keys."""
    rows, out = table.to_pylist(), []
    for kind in sorted({r["kind"] for r in rows}):
        own = [r for r in rows if r["kind"] == kind]
        parts = [np.cumsum(_from_planes(r["keys"], np.uint64), dtype=np.uint64) for r in own]
        keys, index = np.unique(np.concatenate(parts), return_inverse=True)
        cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        totals, others = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for r, a, b in zip(own, cuts[:-1], cuts[1:]):
            if r["fold"] != HELD_OUT:
                counts = _from_planes(r["counts"], np.uint32)
                totals[index[a:b]] += counts
                if r["fold"] == KEPT:
                    others[index[a:b]] += counts
        for r, a, b in zip(own, cuts[:-1], cuts[1:]):
            out.append((r["part"], r["block"], r["fold"], kind, _planes(totals[index[a:b]]),
                        _planes(others[index[a:b]]) if r["fold"] == DELETED else None, None, None, None, None))
        if kind == 1:
            word = keys != _begin_key()
            out.append((rows[0]["part"], None, None, 0, None, None, int(totals[word].sum()), int((totals[word] > 0).sum()),
                        int(others[word].sum()), int((others[word] > 0).sum())))
    return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out), _TOTAL_TYPES)], names=_TOTAL_NAMES)


def _estimates(left: pa.Table, right: pa.Table, column: str, order: int, n: int, v: int):
    """(grams, bucket, p, c): per token the bucket and the estimates of orders 0..order, and its own count."""
    row = left.to_pylist()[0]
    grams = Grams(row["lengths"], row["texts"], order)
    back = sorted(right.select(["kind", "part", column]).to_pylist(), key=lambda r: (r["kind"], r["part"]))
    size = len(grams.at)
    p = np.zeros((order + 1, size))
    p[0] = 1.0 / (v + 1)
    bucket, count, context = np.zeros(size, np.int64), None, None
    for k in range(1, order + 1):
        totals = np.concatenate([_from_planes(r[column], np.int64) for r in back if r["kind"] == k])
        _, index, at = grams.distinct(k)
        seen = totals[index]
        if k == 1:
            count = seen[:size]
            p[1] = count / max(n, 1)
        else:
            seen_context = context > 0
            p[k] = np.where(seen_context, seen[:size] / np.maximum(context, 1), 0.0)
            level = np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64), BUCKETS - 2) + 1
            bucket = np.where(seen_context, (k - 1) * BUCKETS + level, bucket)
        if k < order:
            place = np.zeros(len(grams.sequence), np.int64)
            place[at] = seen
            context = place[grams.at - 1]
    return row, grams, bucket, p, count


def _active(bucket: np.ndarray, order: int) -> np.ndarray:
    """Which orders a bucket mixes: those up to its longest seen context."""
    longest = np.where(bucket == 0, 1, bucket // BUCKETS + 1)
    return np.arange(order + 1)[:, None] <= longest[None, :]


def _weight_cells(order: int, n: int, v: int):
    def run(left, right):
        _, _, bucket, p, _ = _estimates(left, right, "others", order, n, v)
        code = bucket
        for k in range(1, order + 1):
            step = np.where(p[k] > 0, np.minimum((-np.log2(np.maximum(p[k], 1e-300)) * STEPS).astype(np.int64), OCTAVES * STEPS - 2) + 1, 0)
            code = code * (OCTAVES * STEPS) + step
        cells, number = np.unique(code, return_counts=True)
        return pa.table([pa.array(cells), pa.array(number)], names=["cell", "number"])

    return run


def learn_weights(cells: list[tuple[int, int]], order: int, v: int) -> dict[int, list[float]]:
    """Mixture weights of each bucket by expectation-maximisation over (cell, number of tokens)."""
    weights: dict[int, list[float]] = {}
    if not cells:
        return weights
    code, number = (np.array(x) for x in zip(*cells))
    p = np.zeros((order + 1, len(code)))
    p[0] = 1.0 / (v + 1)
    for k in range(order, 0, -1):
        step = code % (OCTAVES * STEPS)
        p[k] = np.where(step > 0, 2.0 ** (-(step - 0.5) / STEPS), 0.0)
        code = code // (OCTAVES * STEPS)
    for b in np.unique(code):
        own, mass = p[:, code == b], number[code == b]
        active = _active(np.array([b]), order)[:, 0]
        lam = active / active.sum()
        for _ in range(ROUNDS):
            share = lam[:, None] * own
            lam = (share / share.sum(axis=0) * mass).sum(axis=1) / mass.sum()
        # no weight is 0 where a later text may need it
        lam = np.where(active, np.maximum(lam, 1e-4), 0.0)
        weights[int(b)] = (lam / lam.sum()).tolist()
    return weights


def _score(order: int, n: int, v: int, weights: dict[int, list[float]]):
    def run(left, right):
        row, grams, bucket, p, count = _estimates(left, right, "totals", order, n, v)
        buckets, index = np.unique(bucket, return_inverse=True)
        even = _active(buckets, order) / _active(buckets, order).sum(axis=0)
        lam = np.array([weights.get(int(b), even[:, i].tolist()) for i, b in enumerate(buckets)]).T
        logs = np.log10((lam[:, index] * p).sum(axis=0))
        base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
        first = np.cumsum(grams.tokens) - grams.tokens
        documents = len(first)
        return pa.table(
            [pa.array(row["doc_ids"], pa.int64()), pa.array([row["fold"] == HELD_OUT] * documents),
             pa.array(grams.tokens), pa.array(np.add.reduceat((count > 0).astype(np.int64), first)),
             pa.array([n] * documents, pa.int64()), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(logs, first))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, held_out, deleted, order: int = ORDER) -> DataFrame:
    """Scores of (doc_id, text); `held_out` and `deleted` are conditions that name the folds."""
    fold = F.when(held_out, HELD_OUT).when(deleted, DELETED).otherwise(KEPT)
    blocks = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("fold"), "text")
                     .mapInArrow(_to_blocks, BLOCK_SCHEMA), "blocks")
    size = blocks.agg(F.sum("size")).first()[0] or 0
    bits = max(0, int(size / PART_BYTES)).bit_length()
    grams = blocks.select("block", "fold", "lengths", "texts").mapInArrow(_send_grams(order, bits), GRAM_SCHEMA)
    totals = written(grams.groupBy("part").applyInArrow(_sum_part, TOTAL_SCHEMA), "totals")
    n, v, n_others, v_others = (x or 0 for x in totals.where("kind = 0").agg(
        F.sum("n"), F.sum("v"), F.sum("n_others"), F.sum("v_others")).first())

    sides = [blocks.select("block", "fold", "doc_ids", "lengths", "texts"), totals.where("kind > 0")]
    learn, back = (x.where(F.col("fold") == DELETED) for x in sides)
    cells = (learn.groupBy("block").cogroup(back.select("block", "part", "kind", "others").groupBy("block"))
             .applyInArrow(_weight_cells(order, n_others, v_others), "cell long, number long")
             .groupBy("cell").agg(F.sum("number").alias("number")))
    weights = learn_weights([(r.cell, r.number) for r in cells.collect()], order, v_others)
    return (sides[0].groupBy("block").cogroup(sides[1].select("block", "part", "kind", "totals").groupBy("block"))
            .applyInArrow(_score(order, n, v, weights), SCORE_SCHEMA))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    return score_documents(corpus_table(spark, sf_dir, "documents", "doc_id", "text"), remainder == 1, remainder == 0)
