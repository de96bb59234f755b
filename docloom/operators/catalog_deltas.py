"""Catalogue reports kept up to date by changes: stored aggregates per user and type that each run's changes are merged into.

Counts add and subtract. How many files there are comes from changes of files, not of chunks, so no distinct count is needed. Sketches of
the distinct sources (HyperLogLog) only grow; they are rebuilt per user and type when more than ``STALE`` of what they saw is gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (user_id, file_type, n_chunks, n_files, n_gone, sources): totals, files that went since the sketch was built, the sketch.
TOTALS = "user_id int, file_type string, n_chunks bigint, n_files bigint, n_gone bigint, sources binary"
KEYS = ["user_id", "file_type"]
STALE = 0.2


def totals_of(chunks: DataFrame) -> DataFrame:
    """The aggregates of a whole chunk table: how they begin."""
    files = chunks.groupBy(*KEYS, "source").agg(F.count(F.lit(1)).alias("n"))
    return files.groupBy(*KEYS).agg(F.sum("n").alias("n_chunks"), F.count(F.lit(1)).alias("n_files"), F.lit(0).cast("bigint").alias("n_gone"), F.hll_sketch_agg("source").alias("sources"))


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(user_id, file_type, source, chunks, files): by how much each changed file of a run changes the totals, from its chunks before and after."""

    keys, one, zero = [*KEYS, "source"], F.lit(1), F.lit(0)
    both = before.select(*keys, one.alias("o"), zero.alias("n")).unionByName(after.select(*keys, zero.alias("o"), one.alias("n")))
    return both.groupBy(*keys).agg(F.sum("o").alias("old"), F.sum("n").alias("new")).select(*keys, (F.col("new") - F.col("old")).alias("chunks"), ((F.col("new") > 0).cast("bigint") - (F.col("old") > 0).cast("bigint")).alias("files"))


def merged(totals: DataFrame, changes: DataFrame) -> DataFrame:
    """``totals`` with ``changes`` of a run; keys without files go. One row for each key that changed meets the totals."""
    sketch = F.hll_sketch_agg(F.when(F.col("files") > 0, F.col("source")))
    delta = changes.groupBy(*KEYS).agg(F.sum("chunks").alias("n_chunks"), F.sum("files").alias("n_files"), F.count_if(F.col("files") < 0).alias("n_gone"), sketch.alias("sources"))
    both = totals.unionByName(delta).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("n_chunks", "n_files", "n_gone")], F.hll_union_agg("sources").alias("sources"))
    return both.where("n_files > 0")


def stale(totals: DataFrame, share: float = STALE) -> DataFrame:
    """(user_id, file_type) whose sketch has seen too many files that are gone."""
    return totals.where(F.col("n_gone") > share * (F.col("n_files") + F.col("n_gone"))).select(*KEYS)


def rebuilt(totals: DataFrame, chunks: DataFrame, share: float = STALE) -> DataFrame:
    """``totals`` with those of ``stale`` keys taken from the chunks of their users and types anew."""
    old = stale(totals, share).select(F.col("user_id").alias("_user"), F.col("file_type").alias("_type"))
    same = F.col("user_id").eqNullSafe(F.col("_user")) & F.col("file_type").eqNullSafe(F.col("_type"))
    return totals.join(old, same, "left_anti").unionByName(totals_of(chunks.join(old, same, "left_semi")))


def type_report(totals: DataFrame) -> DataFrame:
    """(user_id, file_type, n_chunks, n_files, about): exact totals, and the sketch's estimate of the distinct sources."""
    return totals.select("user_id", F.coalesce("file_type", F.lit("unknown")).alias("file_type"), "n_chunks", "n_files", F.hll_sketch_estimate("sources").alias("about"))


def user_report(totals: DataFrame) -> DataFrame:
    """(user_id, chunk_count, file_count), as ``index_stats`` counts them."""
    return totals.groupBy("user_id").agg(F.sum("n_chunks").alias("chunk_count"), F.sum("n_files").alias("file_count"))
