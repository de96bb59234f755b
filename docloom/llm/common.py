"""What the operators share: reading tables, scratch tables, free column names."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.scratch import discard, materialise

__all__ = ["content_key", "discard", "free_name", "id_bucket", "materialise", "read_table"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use (names compare without case)."""
    used = {c.lower() for c in df.columns}
    while base.lower() in used:
        base = f"_{base}"
    return base


def content_key(value: object) -> str:
    """A digest of a model's content: workers keep what they built from it under this key."""
    return hashlib.sha256(repr(value).encode("utf-8", "surrogatepass")).hexdigest()


def id_bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus
