"""Text quality by Naive Bayes support vectors.

A document is the set of its n-grams: words and pairs of words (A-Z lower-cased), and
runs of three bytes as they are, so that case, symbols and punctuation count.  A word
that repeats the one before, or the one as many words before as any of `ECHOES`, also
counts as an n-gram of its own ("the same again"), whatever the word.  N-grams are
hashed to 2^BITS cells.

Each indicator is scaled by its cell's log-count ratio between good and bad texts
(Naive Bayes); the scaled vector, at unit length, goes to a linear model with hinge
loss, fitted by dual coordinate descent: one document's dual variable at a time is
set to its optimum inside its box.  The weights are then drawn towards their mean
size (`MIX`), where the model would be Naive Bayes again.  A logistic function of the
margin, fitted on labelled documents that gave neither counts nor weights, makes the
score a probability.

The model learns from at most `LABELLED` labelled rows with at most `FEATURES`
n-grams in all, in the order of a hash; everything is scored, whole.

Defined results: null and empty texts have no n-gram and get the score of a text
without evidence; without labels of both kinds every score is the smoothed share of
good labels; repeated rows are scored alike; several labels of one document count as
good if one is; very long texts are taken whole; empty tables give empty results;
other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerlens.llm.tables import corpus_table, written
from ledgerlens.llm.words import lower_ascii, mix, separator_table, text_buffer, text_chunks, word_hashes, word_spans

BITS = 20
ECHOES = (1, 2, 3, 4, 8)
SMOOTHING = 1.0
COST = 1.0
MIX = 0.5
EPOCHS = 30
SETTLED = 0.01
THRESHOLD = 0.7
LABELLED = 8_000
FEATURES = 16_000_000

SCORE_SCHEMA = "doc_id long, score double, predicted int, margin double"


@dataclass
class Model:
    weights: np.ndarray     # per cell: its scale times its weight
    scale: np.ndarray       # per cell: the log-count ratio
    bias: float
    slope: float            # logistic function of the margin
    base: float


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4


def _cells(column):
    """The distinct cells of each text, in turn."""
    data, offsets = text_buffer(column)
    shift64, shift32 = np.uint64(64 - BITS), np.uint32(32 - BITS)
    low, space = lower_ascii(data), separator_table("space")
    starts, ends, first = word_spans(data, offsets, space)
    words = word_hashes(low, starts, ends)
    one = (mix(words) >> shift64).astype(np.int32)
    two = (mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) >> shift64).astype(np.int32)
    plain = np.where(space[data], np.uint8(0x20), data).astype(np.uint32)
    three = ((plain[:-2] | plain[1:-1] << 8 | plain[2:] << 16) * np.uint32(0x9E3779B1) >> shift32).astype(np.int32) if len(plain) > 2 else np.zeros(0, np.int32)
    echo = (mix(np.arange(1, max(ECHOES) + 1, dtype=np.uint64)) >> shift64).astype(np.int32)
    place = np.zeros(1 << BITS, np.int32)
    for d in range(len(first) - 1):
        a, b, x, y = first[d], first[d + 1], offsets[d], offsets[d + 1]
        again = [echo[k - 1] for k in ECHOES if (words[a + k:b] == words[a:max(a, b - k)]).any()]
        own = np.concatenate([one[a:b], two[a:max(a, b - 1)], three[x:max(x, y - 2)], np.array(again, np.int32)])
        order = np.arange(len(own), dtype=np.int32)
        place[own] = order
        yield own[place[own] == order]      # the last place of each cell


def _labelled_cells(batches):
    for chunk in text_chunks(batches, "text"):
        cells = [np.sort(c) for c in _cells(chunk.column("text"))]
        offsets = np.concatenate([[0], np.cumsum([len(c) for c in cells])])
        lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(np.concatenate(cells)))
        yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), chunk.column("good"), chunk.column("calibration"), lists.cast(pa.list_(pa.int32()))],
                                         names=["doc_id", "good", "calibration", "cells"])


def count_ratios(sets: list[np.ndarray], good: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """The log-count ratio of every cell; 0 for a cell that no text has."""
    counts = np.zeros((2, 1 << BITS))
    for cells, y in zip(sets, good):
        counts[int(y), cells] += 1
    share = (counts + smoothing) / (counts + smoothing).sum(axis=1, keepdims=True)
    return np.where(counts.sum(axis=0) > 0, np.log(share[1] / share[0]), 0.0)


def unit(cells: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The scaled indicators of one text at unit length."""
    x = scale[cells]
    norm = np.sqrt(x @ x)
    return x / norm if norm > 0 else x


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, box: np.ndarray, size: int,
                 epochs: int = EPOCHS, settled: float = SETTLED) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, bias, dual variables) of min |w|^2/2 + sum of box * max(0, 1 - y (w x + bias)), x given as (cells, values).

    The bias is the weight of a constant feature.  One dual variable at a time goes
    to its optimum in [0, box]; rounds end when none would move by a gradient of `settled`.
    """
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    diagonal = np.array([v @ v + 1.0 for _, v in rows])
    random = np.random.default_rng(0)
    for _ in range(epochs):
        worst = 0.0
        for i in random.permutation(len(rows)):
            cells, values = rows[i]
            gradient = y[i] * (w[cells] @ values + bias) - 1
            projected = min(gradient, 0.0) if alpha[i] <= 0 else max(gradient, 0.0) if alpha[i] >= box[i] else gradient
            worst = max(worst, abs(projected))
            if projected:
                new = min(max(alpha[i] - gradient / diagonal[i], 0.0), box[i])
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[cells] += step * values
                bias += step
        if worst < settled:
            break
    return w, bias, alpha


def logistic(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """(slope, base) of the probability of good by margin: Newton steps on targets drawn off 0 and 1 by one pseudo-count."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * w)
    return float(w[0]), float(w[1])


def _margin(cells: np.ndarray, model: Model) -> float:
    x = model.scale[cells]
    norm = float(np.sqrt((x * x).sum(dtype=np.float64)))
    return (float(model.weights[cells].sum(dtype=np.float64)) / norm if norm > 0 else 0.0) + model.bias


def train(sets: list[np.ndarray], good: np.ndarray, calibration: np.ndarray, cost: float = COST, blend: float = MIX) -> Model:
    """The model of texts given as sets of cells, their labels, and which of them calibrate."""
    learn = np.flatnonzero(~calibration)
    own, y = [sets[i] for i in learn], good[learn]
    none = Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0.0, 0.0, float(np.log((good.sum() + 1) / ((~good).sum() + 1))))
    if len(set(y.tolist())) < 2:
        return none
    scale = count_ratios(own, y)
    # either label has the same weight in all
    box = cost * np.where(y, len(y) / (2 * y.sum()), len(y) / (2 * (~y).sum()))
    w, bias, _ = dual_descent([(c, unit(c, scale)) for c in own], np.where(y, 1.0, -1.0), box, 1 << BITS)
    used = scale != 0
    w = np.where(used, (1 - blend) * np.abs(w[used]).mean() + blend * w, 0.0) if used.any() else w
    model = Model((w * scale).astype(np.float32), scale.astype(np.float32), bias, 1.0, 0.0)
    rest = np.flatnonzero(calibration)
    if len(set(good[rest].tolist())) < 2:
        return model
    model.slope, model.base = logistic(np.array([_margin(sets[i], model) for i in rest]), good[rest])
    return model


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, calibration: Column, labelled: int = LABELLED, features: int = FEATURES) -> Model:
    """Learn from labelled documents that are not held out; `calibration` names those that only calibrate."""
    sample = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"))
              .withColumn("calibration", calibration).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    known = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")   # `labelled` rows at most
                    .mapInArrow(_labelled_cells, "doc_id long, good boolean, calibration boolean, cells array<int>"), "labelled")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("cells")]
    first = known.select(*order, F.size("cells").alias("n")).toDF("h", "doc_id", "key", "n").orderBy("h", "doc_id", "key").limit(labelled)
    taken = first.withColumn("sum", F.sum("n").over(Window.orderBy("h", "doc_id", "key"))).where(F.col("sum") <= features).select("doc_id", "key").distinct()
    rows = (known.withColumn("key", F.xxhash64("cells")).join(F.broadcast(taken), ["doc_id", "key"], "left_semi")
            .dropDuplicates(["doc_id", "key"]).orderBy(*order).select("good", "calibration", "cells").toArrow())
    cells = rows.column("cells").combine_chunks()
    offsets, flat = np.asarray(cells.offsets), np.asarray(cells.values)
    sets = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    return train(sets, *(np.asarray(rows.column(c).to_pylist(), bool) for c in ("good", "calibration")))


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per document of (doc_id, text): score (the probability of good quality), predicted, and the margin."""
    def run(batches):
        for chunk in text_chunks(batches, "text"):
            margins = np.array([_margin(cells, model) for cells in _cells(chunk.column("text"))])
            scores = 1 / (1 + np.exp(-np.clip(model.slope * margins + model.base, -30, 30)))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(margins)],
                                             names=["doc_id", "score", "predicted", "margin"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORE_SCHEMA)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus_table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, corpus_table(spark, sf_dir, "labels", "doc_id", "quality"), remainder() == 2, remainder() == 1)
    return score_documents(docs, model).withColumn("held_out", F.coalesce(remainder() == 2, F.lit(False)))
