"""Parquet tables as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_documents(df: DataFrame, text: str | Column, path: Column, doc_id: str | None = None, title: Column | None = None, metadata: Column | None = None) -> DataFrame:
    """Rows to index, of a table's columns."""
    cols = [F.col(doc_id).cast("long").alias("doc_id")] if doc_id else []
    text = F.col(text) if isinstance(text, str) else text
    return df.select(*cols, path.alias("path"), text.alias("text"), (title if title is not None else F.lit(None).cast("string")).alias("title"), (metadata if metadata is not None else F.lit(None).cast("string")).alias("metadata"))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The table ``documents``, with source and id as the path."""
    docs = table(spark, folder, "documents")
    return as_documents(docs, "text", F.concat_ws("/", "source", F.col("doc_id").cast("string")), "doc_id")
