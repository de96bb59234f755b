"""Content-addressed caches as tables (key, digest, value): look-ups are joins, and repeats are worked off once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(content: Column) -> Column:
    """The full SHA-256 in hex: what joins use, for 64 bits are too few for very many keys."""
    return F.sha2(content.cast("binary"), 256)


def cache_key(operation: str, content: Column) -> Column:
    """``operation:`` and 16 hex digits, as shown to people."""
    return F.concat(F.lit(f"{operation}:"), F.substring(digest(content), 1, 16))


def chunk_cache_key(text: Column, max_len: int, overlap: int, ocr: tuple[str, int] | None = None) -> Column:
    """The key of chunks: the text and every parameter that shapes them; ``ocr`` is (strategy, threshold)."""
    parameters = ["no_ocr"] if ocr is None else ["ocr", ocr[0], str(ocr[1])]
    return cache_key("chunks", F.concat_ws("|", digest(text), F.lit(str(max_len)), F.lit(str(overlap)), *map(F.lit, parameters)))


def with_digest(rows: DataFrame, content: str) -> DataFrame:
    return rows.withColumn("digest", digest(F.col(content)))


def look_up(rows: DataFrame, cache: DataFrame, value: str = "value") -> DataFrame:
    """``rows`` (with ``digest``) with the cached value and ``hit``."""
    return rows.join(cache.select("digest", F.col(value), F.lit(True).alias("hit")), "digest", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def misses(rows: DataFrame, cache: DataFrame, content: str) -> DataFrame:
    """(digest, content) once for each content that is not cached.

    Only the rows of digests that the cache lacks bring their content, and of these each task keeps one per digest before they travel.
    """
    missing = rows.select("digest").distinct().join(cache.select("digest"), "digest", "left_anti")
    return distinct_contents(rows.join(missing, "digest", "left_semi"), content)


def distinct_contents(rows: DataFrame, content: str) -> DataFrame:
    """(digest, content) once for each digest."""
    return rows.groupBy("digest").agg(F.any_value(content).alias(content))


def write_back(cache: DataFrame, made: DataFrame) -> DataFrame:
    """The cache with the new keys of ``made``; known keys keep their value."""
    return cache.unionByName(made.join(cache.select("digest"), "digest", "left_anti"), allowMissingColumns=True)


def hit_report(rows: DataFrame) -> DataFrame:
    """(n_rows, n_hits, n_missing_keys) of looked-up rows."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("hit").alias("n_hits"), F.count_distinct(F.when(~F.col("hit"), F.col("digest"))).alias("n_missing_keys"))


def cache_stats(caches: dict[str, DataFrame], value: str = "value") -> DataFrame:
    """(kind, n_entries, n_bytes) of caches by kind; values are measured as text."""
    out = None
    for kind, cache in caches.items():
        part = cache.select(F.lit(kind).alias("kind"), F.octet_length(F.col(value).cast("string")).alias("size"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n_entries"), F.sum("size").alias("n_bytes"))


def clear(cache: DataFrame) -> DataFrame:
    return cache.limit(0)
