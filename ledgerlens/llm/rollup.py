"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A batch of changes (documents inserted, deleted, or counted anew) is reduced to
one signed row per key and written as a part of its own; a marker row, appended when
the part is whole, makes it the batch's part.  So readers see a batch as it was or as
it is, never without it: a commit that is cut off leaves the old totals, and
committing the same batch again (a repeated or restarted commit) puts equal rows in
the place of the old ones.  Other rows under an old name replace the old ones too.
Totals are the sums over all batches; they never need the documents again.

A revised document is its old count taken away and its new one added.

Defined results: null and empty texts count 0 tokens and 1 document; a null
source or language is a key of its own; repeated rows count each time; keys whose
documents are all gone are left out; empty tables give empty results; other
columns are not read.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm.bpe import RANKS, VOCABULARY, Encoder
from ledgerlens.llm.tables import corpus_table, shared_folder, written
from ledgerlens.llm.words import hashed_words, text_chunks

KEYS = ["source", "lang", "version"]
PART_SCHEMA = "source string, lang string, version string, documents long, tokens long, batch string, part string"
MARKER_SCHEMA = "batch string, part string, turn long"
COUNT_SCHEMA = "doc_id long, source string, lang string, text_key string, version string, tokens long, revised long"


class Rollup:
    """Signed totals in a shared folder, a part for each committed batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.parts, self.markers = spark, f"{folder}/parts", f"{folder}/markers"
        spark.createDataFrame([], MARKER_SCHEMA).write.mode("ignore").parquet(self.markers)     # where the rollup is new

    def _marked(self) -> DataFrame:
        """The valid part of each batch (a row per batch): that of its last marker."""
        last = self.spark.read.schema(MARKER_SCHEMA).parquet(self.markers).groupBy("batch").agg(F.max(F.struct("turn", "part")).alias("m"))
        return last.select("batch", "m.part", "m.turn")

    def _mark(self, batch: str, part: str) -> None:
        turn = self._marked().where(F.col("batch") == batch).agg(F.coalesce(F.max("turn"), F.lit(0))).first()[0] + 1
        self.spark.createDataFrame([(batch, part, turn)], MARKER_SCHEMA).coalesce(1).write.mode("append").parquet(self.markers)

    def commit(self, batch: str, inserted: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Record a batch of per-document counts (the keys and `tokens`) that come or go."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"a batch is named by letters, digits, - and _: {batch!r}")
        changes = None
        for frame, sign in ((inserted, 1), (removed, -1)):
            if frame is not None:
                own = frame.groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).select(
                    *KEYS, (sign * F.col("n")).alias("documents"), (sign * F.col("t")).alias("tokens"))
                changes = own if changes is None else changes.unionByName(own)
        if changes is None:
            raise ValueError("a batch inserts or removes something")
        summed = changes.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        part = uuid.uuid4().hex
        summed.write.parquet(f"{self.parts}/batch={batch}/part={part}")
        self._mark(batch, part)

    def totals(self) -> DataFrame:
        valid = self._marked()
        if valid.isEmpty():
            return self.spark.createDataFrame([], PART_SCHEMA).drop("batch", "part")
        signed = self.spark.read.schema(PART_SCHEMA).parquet(self.parts).join(valid, ["batch", "part"], "left_semi")
        return (signed.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
                .where("documents <> 0 or tokens <> 0"))


def without_repeated_lines(text: str) -> str:
    return "\n".join(dict.fromkeys(text.split("\n")))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """Per document and tokenizer version: tokens, and tokens once repeated lines are dropped."""
    def run(batches):
        encoder = Encoder(vocabulary, ranks)
        for chunk in text_chunks(batches, "text"):
            texts = [t or "" for t in chunk.column("text").to_pylist()]
            fewer = [without_repeated_lines(t) for t in texts]
            bpe = [len(encoder.encode(t)) // 4 for t in texts]
            bpe_fewer = [n if a == b else len(encoder.encode(b)) // 4 for n, a, b in zip(bpe, texts, fewer)]
            words, words_fewer = ([int(b - a) for a, b in zip(first[:-1], first[1:])]
                                  for first in (hashed_words(pa.array(t, pa.string()), "space")[1] for t in (texts, fewer)))
            for version, n, m in (("byte_bpe_50k", bpe, bpe_fewer), ("words", words, words_fewer)):
                yield pa.RecordBatch.from_arrays(
                    [*(chunk.column(c) for c in ("doc_id", "source", "lang", "text_key")),
                     pa.array([version] * len(texts)), pa.array(n, pa.int64()), pa.array(m, pa.int64())],
                    names=["doc_id", "source", "lang", "text_key", "version", "tokens", "revised"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.col("lang").cast("string").alias("lang"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_key"),
                       "text").mapInArrow(run, COUNT_SCHEMA)


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four commits: all documents, those with repeated lines counted anew without the
    repeats, copies of a text deleted (all but its smallest doc_id), and the second batch once more."""
    counts = written(count_tokens(corpus_table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")), "counts")
    rollup = Rollup(spark, shared_folder(spark, "rollup"))
    rollup.commit("load", inserted=counts)
    changed = counts.where("revised <> tokens")
    anew = changed.withColumn("tokens", F.col("revised"))
    rollup.commit("revise", inserted=anew, removed=changed)
    first = counts.groupBy("text_key").agg(F.min("doc_id").alias("first_id"))
    copies = (counts.join(first, "text_key").where(~F.col("doc_id").eqNullSafe(F.col("first_id")))
              .withColumn("tokens", F.col("revised")))
    rollup.commit("delete-copies", removed=copies)
    rollup.commit("revise", inserted=anew, removed=changed)
    return rollup.totals()
