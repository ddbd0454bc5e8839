"""A1: document sources. Parquet tables and plain text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy per-row work (regex, folds) enough tasks.

    A small table read from one file is one split, so every core but one
    idles. When the scan yields fewer partitions than the cluster has cores
    the rows are spread round-robin; a large input (many splits) is left
    exactly as scanned, so at scale this adds no shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str, spread_rows: bool = False) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if spread_rows else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", spread_rows=True).select("doc_id", "text", "lang", "source", "n_chars")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture's query batch: (query_id, text)."""
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def read_text(spark: SparkSession, paths) -> DataFrame:
    """A1: one document per file: doc_id = xxhash64(path), text, source = path."""
    if isinstance(paths, str):
        paths = [paths]
    raw = spark.read.text(list(paths), wholetext=True)
    return raw.select(
        F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"),
        F.col("value").alias("text"),
        F.col("_metadata.file_path").alias("source"),
        F.length("value").cast("bigint").alias("n_chars"),
    )
