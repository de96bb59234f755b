"""Catalogue reports over the chunk table, for all users in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import extension


def list_documents(chunks: DataFrame) -> DataFrame:
    """(user_id, source, file_type, chunk_count, last_modified); grouped on the stored type, so null and ``unknown`` stay apart."""
    files = chunks.groupBy("user_id", "source", "file_type").agg(F.count(F.lit(1)).alias("chunk_count"), F.max("file_mtime").alias("last_modified"))
    return files.withColumn("file_type", F.coalesce("file_type", F.lit("unknown")))


def file_types(chunks: DataFrame) -> DataFrame:
    """(user_id, file_type, n_chunks, n_files). Sources are made distinct first, so the count needs no expansion."""
    sources = chunks.groupBy("user_id", "file_type", "source").agg(F.count(F.lit(1)).alias("n"))
    types = sources.groupBy("user_id", "file_type").agg(F.sum("n").alias("n_chunks"), F.count(F.lit(1)).alias("n_files"))
    return types.withColumn("file_type", F.coalesce("file_type", F.lit("unknown")))


def approximate_file_types(chunks: DataFrame, error: float = 0.02) -> DataFrame:
    """``file_types`` with sketched file counts, for catalogues whose distinct sources are too many to shuffle."""
    types = chunks.groupBy("user_id", "file_type").agg(F.count(F.lit(1)).alias("n_chunks"), F.approx_count_distinct("source", error).alias("n_files"))
    return types.withColumn("file_type", F.coalesce("file_type", F.lit("unknown")))


def index_stats(chunks: DataFrame) -> DataFrame:
    """(user_id, chunk_count, file_count); a source stored under two types counts twice."""
    return file_types(chunks).groupBy("user_id").agg(F.sum("n_chunks").alias("chunk_count"), F.sum("n_files").alias("file_count"))


def indexed_files(chunks: DataFrame) -> DataFrame:
    """(user_id, source, chunk_count)."""
    return chunks.groupBy("user_id", "source").agg(F.count(F.lit(1)).alias("chunk_count"))


def corpus_totals(chunks: DataFrame) -> DataFrame:
    """(user_id, n_files, n_chunks), each source once."""
    return indexed_files(chunks).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("chunk_count").alias("n_chunks"))


def path_types(chunks: DataFrame) -> DataFrame:
    """(user_id, file_type, n_files) by the extension of the path, each source once."""
    ext = extension("source")
    named = chunks.select("user_id", "source").distinct().select("user_id", F.when(ext == "", "unknown").otherwise(ext).alias("file_type"))
    return named.groupBy("user_id", "file_type").agg(F.count(F.lit(1)).alias("n_files"))
