"""Reading the corpus tables and writing shared intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.session import ensure_checkpoint_dir


def corpus_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; a column that it lacks is an error of the caller."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, for one run's written tables."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: Column | None = None) -> Column:
    """SHA-256 of a row's text: with doc_id it tells documents apart."""
    return F.unhex(F.sha2(F.coalesce(F.col("text") if text is None else text, F.lit("")), 256))


def matched(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Documents joined (semi or anti) with the (doc_id, text_key) of ``marks``, null ids too; their columns may have any names."""
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("m.doc_id")) & (text_key(F.col("d.text")) == F.col("m.text_key"))
    return docs.alias("d").join(marks.alias("m"), same, how)
