"""Toxic passages as maximum-scoring segments, calibrated by extreme-value statistics.

Every word and every beginning of a word (3 to 8 bytes: inflected forms share a
stem) has a log-odds between toxic and clean texts under a Dirichlet prior that
holds `PRIOR` pseudo-words split as if it said nothing; a word's score is their
mean.  Less a drift for each word, a text becomes a walk whose maximal segments (all of them, found
in one linear scan) are its candidate passages.  The highest segment of a clean
text follows an extreme-value law with rate `lam` (the root of
E[exp(lam * score)] = 1 over clean words) and `ln_k`, so a segment of score s in n
words has the p-value 1 - exp(-exp(ln_k + ln n - lam * s)).  A logistic function
of the normalised scores, fitted on documents that gave no counts, makes the
document's score.

Words and stems are hashed to 2^BITS cells, which bounds the table that tasks
receive (8 MB).
The model learns from at most `LABELLED` labelled documents (by hash of their id);
everything is scored, whole.

Defined results: null and empty texts have no passage and get the score of a text
without evidence; without labels of both kinds the score is that of an even prior;
repeated rows are scored alike; several labels of one document count as toxic if
one is; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.llm.tables import corpus_table, written
from ledgerlens.llm.words import lower_ascii, mix, separator_table, text_buffer, text_chunks, word_hashes, word_spans

BITS = 21
STEMS = range(3, 9)
PRIOR = 5.0
DRIFT = 0.3
SIGNIFICANT = 0.01
LABELLED = 30_000
SCORE_BINS, BIN_WIDTH, LOWEST = 600, 0.05, -15.0

SCORE_SCHEMA = "doc_id long, score double, predicted int, n_passages int, passages string"


@dataclass
class Model:
    scores: np.ndarray      # per cell
    lam: float
    ln_k: float
    weights: np.ndarray     # logistic: constant, highest segment, sum of significant segments, their sum by length


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5


def _words(column):
    """Bytes and spans of the words, and their cells: a row for the words, one for each length of stem (-1: the word is no longer)."""
    data, offsets = text_buffer(column)
    starts, ends, first = word_spans(data, offsets, separator_table("alnum"))
    low = lower_ascii(data)
    padded = np.zeros(len(low) + 8, np.uint8)
    padded[:len(low)] = low
    lane = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(low) + 1,), strides=(1,))[starts]
    shift, length = np.uint64(64 - BITS), ends - starts
    cells = np.empty((1 + len(STEMS), len(starts)), np.int32)
    cells[0] = word_hashes(low, starts, ends) >> shift
    for row, k in enumerate(STEMS, 1):
        mask = np.uint64((1 << 8 * k) - 1)
        cells[row] = mix((lane & mask) + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> shift
        cells[row, length <= k] = -1
    return data, offsets, starts, ends, first, cells


def _values(scores: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Each word's score: the mean of its cells', the drift taken off."""
    used = cells >= 0
    return np.where(used, scores[cells], 0).sum(axis=0) / used.sum(axis=0) - DRIFT


def _count_cells(batches):
    """Counts of words and stems in the toxic and in the clean documents, by cell."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    for chunk in text_chunks(batches, "text"):
        *_, first, cells = _words(chunk.column("text"))
        toxic = np.repeat(np.asarray(chunk.column("toxic")) == 1, np.diff(first))
        for k, own in enumerate((~toxic, toxic)):
            for row in cells[:, own]:
                counts[k] += np.bincount(row[row >= 0], minlength=1 << BITS)
    used = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0, used]), pa.array(counts[1, used])],
                                     names=["cell", "clean", "toxic"])


def _clean_scores(scores: np.ndarray):
    """Histogram of the word scores of clean documents."""
    def run(batches):
        counts = np.zeros(SCORE_BINS, np.int64)
        for chunk in text_chunks(batches, "text"):
            bins = ((_values(scores, _words(chunk.column("text"))[-1]) - LOWEST) / BIN_WIDTH).astype(np.int64)
            counts += np.bincount(np.clip(bins, 0, SCORE_BINS - 1), minlength=SCORE_BINS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bin", "n"])

    return run


def log_odds(clean: np.ndarray, toxic: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Log-odds of each cell: its counts and the prior's against the prior's, in toxic and in clean texts."""
    total = max(1, clean.sum() + toxic.sum())
    a0, a1 = prior * max(clean.sum(), 1) / total, prior * max(toxic.sum(), 1) / total
    return np.log((toxic + a1) / a1) - np.log((clean + a0) / a0)


def tail_rate(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of E[exp(rate * score)] = 1, by bisection; 1 where scores are never positive or don't drift down."""
    mass = counts / max(1, counts.sum())
    if not (mass * scores).sum() < 0 or not scores[counts > 0].max(initial=-1) > 0:
        return 1.0
    low, high = 1e-6, 1.0
    grown = lambda x: (mass * np.exp(np.minimum(x * scores, 700))).sum()
    while grown(high) < 1:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if grown(mid) < 1 else (low, mid)
    return (low + high) / 2


def maximal_segments(scores) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end exclusive, score) of a sequence, in one linear scan."""
    # each candidate: begin, end, sum before it, sum at its end, link to the nearest one with a smaller sum before
    stack: list[list] = []
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total, len(stack) - 1]
        while True:
            j = new[4]
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            new[4] = j
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new[0], new[2], new[4] = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
    return [(a, b, right - left) for a, b, left, right, _ in stack]


def _evidence(values: np.ndarray, model: Model) -> tuple[float, float, list[tuple[int, int, float]]]:
    """(highest segment, sum of significant segments, these segments), the scores normalised."""
    if not len(values):
        return 0.0, 0.0, []
    walk = np.concatenate([[0.0], np.cumsum(values)])
    highest = float((walk - np.minimum.accumulate(walk)).max())
    ground = model.ln_k + np.log(len(values))
    limit = -np.log(-np.log1p(-SIGNIFICANT))
    if highest <= 0:
        return 0.0, 0.0, []
    top = model.lam * highest - ground
    if top <= limit:
        return max(0.0, top), 0.0, []
    found = [(a, b, model.lam * s - ground) for a, b, s in maximal_segments(values.tolist()) if model.lam * s - ground > limit]
    return top, sum(x[2] for x in found), found


def _features(evidence: tuple[float, float, list], n: int) -> list[float]:
    return [1.0, float(np.log1p(evidence[0])), float(np.log1p(evidence[1])), float(np.log1p(100 * evidence[1] / max(n, 1)))]


def _highest(scores: np.ndarray):
    """The highest segment of each text."""
    def run(batches):
        for chunk in text_chunks(batches, "text"):
            *_, first, cells = _words(chunk.column("text"))
            walk, out = _values(scores, cells), []
            for a, b in zip(first[:-1], first[1:]):
                own = np.concatenate([[0.0], np.cumsum(walk[a:b])])
                out.append((int(b - a), float((own - np.minimum.accumulate(own)).max())))
            yield pa.RecordBatch.from_arrays([chunk.column("toxic"), *(pa.array(list(c)) for c in zip(*out))], names=["toxic", "n", "highest"])

    return run


def _feature_rows(model: Model):
    def run(batches):
        for chunk in text_chunks(batches, "text"):
            *_, first, cells = _words(chunk.column("text"))
            values = _values(model.scores, cells)
            rows = [_features(_evidence(values[a:b], model), b - a) for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([chunk.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-stabilised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [0.1] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    return w


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, calibration: Column, labelled: int = LABELLED) -> Model:
    """Learn from labelled documents that are not held out; `calibration` names those that give no counts."""
    # at most `labelled` rows: small enough to send to every task
    sample = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
              .withColumn("calibration", calibration).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    known = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id"), "labelled")
    cells = (known.where(~F.col("calibration")).select("toxic", "text").mapInArrow(_count_cells, "cell long, clean long, toxic long")
             .groupBy("cell").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))).toArrow()  # 2^BITS rows at most
    clean, toxic = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    clean[np.asarray(cells["cell"])] = np.asarray(cells["clean"])
    toxic[np.asarray(cells["cell"])] = np.asarray(cells["toxic"])
    scores = log_odds(clean, toxic).astype(np.float32)

    other = known.where("calibration").select("toxic", "text")
    bins = (other.where("toxic = 0").select("text").mapInArrow(_clean_scores(scores), "bin long, n long")
            .groupBy("bin").agg(F.sum("n").alias("n"))).toPandas()      # SCORE_BINS rows at most
    lam = tail_rate(LOWEST + BIN_WIDTH * (bins["bin"].to_numpy(float) + 0.5), bins["n"].to_numpy(float))
    model = Model(scores, lam, 0.0, np.zeros(4))
    seen = other.mapInArrow(_highest(scores), "toxic int, n long, highest double").toPandas()     # as many rows as labels
    plain = seen[(seen["toxic"] == 0) & (seen["n"] > 0) & (seen["highest"] > 0)]
    if len(plain):
        # the middle of the law, which a few mislabelled texts don't move: exp(-K n e^(-lam s)) = 1/2
        model.ln_k = float(np.median(lam * plain["highest"] - np.log(plain["n"])) + np.log(np.log(2.0)))
    if seen["toxic"].nunique() == 2:
        rows = other.mapInArrow(_feature_rows(model), "toxic int, x array<double>").toPandas()
        model.weights = _logistic(np.stack(rows["x"]).astype(float), rows["toxic"].to_numpy(float))
    return model


def _scores(chunk, model: Model):
    data, offsets, starts, ends, first, cells = _words(chunk.column("text"))
    values = _values(model.scores, cells)
    for d, (a, b) in enumerate(zip(first[:-1], first[1:])):
        evidence = _evidence(values[a:b], model)
        score = float(1 / (1 + np.exp(-np.clip(model.weights @ _features(evidence, b - a), -30, 30))))
        spans = []
        if evidence[2]:
            text = data[offsets[d]:offsets[d + 1]]
            place = np.cumsum((text & 0xC0) != 0x80)   # code points up to and with each byte
            spans = [f"{place[starts[a + i] - offsets[d]] - 1}:{place[ends[a + j - 1] - offsets[d] - 1]}" for i, j, _ in evidence[2]]
        yield score, spans


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Per document of (doc_id, text): score, predicted and its toxic passages (code points begin:end)."""
    def run(batches):
        for chunk in text_chunks(batches, "text"):
            score, spans = zip(*_scores(chunk, model))
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(score), pa.array([int(s >= 0.5) for s in score], pa.int32()),
                 pa.array([len(s) for s in spans], pa.int32()), pa.array([",".join(s) for s in spans])],
                names=["doc_id", "score", "predicted", "n_passages", "passages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORE_SCHEMA)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all columns, that the model doesn't call toxic."""
    def run(batches):
        for chunk in text_chunks(batches, "text"):
            yield chunk.filter(pa.array([score < 0.5 for score, _ in _scores(chunk, model)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fit_tables(spark: SparkSession, sf_dir: str) -> Model:
    """The model of the labels table: fold 0 is held out, fold 1 calibrates."""
    return fit(corpus_table(spark, sf_dir, "documents", "doc_id", "text"), corpus_table(spark, sf_dir, "labels", "doc_id", "toxic"),
               remainder() == 0, remainder() == 1)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_tables(spark, sf_dir)
    return (score_documents(corpus_table(spark, sf_dir, "documents", "doc_id", "text"), model)
            .withColumn("held_out", F.coalesce(remainder() == 0, F.lit(False))))
