"""The corpus pipeline: toxicity, near-duplicates, decontamination, secrets, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame over all that the stage before it
kept; all but the last return the columns of documents.  A document is a row: rows
with one id, or none, are judged each by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm.decontaminate import without_contaminated
from ledgerlens.llm.neardup import without_near_duplicates
from ledgerlens.llm.packing import pack
from ledgerlens.llm.secret_scan import without_secrets
from ledgerlens.llm.tables import corpus_table, written
from ledgerlens.llm.toxicity import fit_tables, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic go."""
    return without_toxic(docs, fit_tables(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity 0.8) stays: the smallest doc_id's."""
    return without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word passage of a benchmark item (or a whole shorter item) go."""
    return without_contaminated(docs, corpus_table(spark, sf_dir, "benchmark", "item_id", "text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, and n_chars counted anew; no document goes."""
    return without_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, packed into sequences."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("secrets", secrets), ("packing", packing)]

#: Models, sketches and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = corpus_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
