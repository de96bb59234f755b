"""Change detection and maintenance of the chunk table: inserts, replacements, deletions, users."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.schemas import CHUNK_COLUMNS, CHUNKS

NEW, MODIFIED, UNCHANGED, DELETED = "new", "modified", "unchanged", "deleted"
FILE = ["user_id", "source"]


def existing_files(chunks: DataFrame, scope: str | None = None) -> DataFrame:
    """(user_id, source, content_hash): the latest stored hash of each source; ``scope`` limits to a path prefix."""
    hashed = chunks.where("content_hash IS NOT NULL")
    if scope is not None:
        hashed = hashed.where(F.startswith("source", F.lit(scope)))
    latest = F.max_by("content_hash", F.struct("file_mtime", "content_hash")).alias("content_hash")
    return hashed.groupBy(*FILE).agg(latest)


def classify(current: DataFrame, existing: DataFrame) -> DataFrame:
    """(user_id, source, content_hash, mtime, status) of the union of both sides.

    ``current`` has user_id, source, content_hash and mtime. Only hashes decide; keep both sides narrow, for a
    full outer join shuffles both.
    """
    stored = existing.select(*FILE, F.col("content_hash").alias("stored"))
    joined = current.select(*FILE, "content_hash", "mtime").withColumn("_here", F.lit(True)).join(stored, FILE, "full_outer")
    status = F.when(F.col("_here").isNull(), DELETED).when(F.col("stored").isNull(), NEW).when(F.col("stored") != F.col("content_hash"), MODIFIED).otherwise(UNCHANGED)
    return joined.select(*FILE, F.coalesce("content_hash", "stored").alias("content_hash"), "mtime", status.alias("status"))


def to_process(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("status").isin(NEW, MODIFIED))


def to_delete(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("status") == DELETED)


def summary(classified: DataFrame, samples: int = 5) -> DataFrame:
    """(user_id, status, n_files, sample): counts, and the first few paths of what changed."""
    order = Window.partitionBy("user_id", "status").orderBy("source")
    placed = classified.select("user_id", "status", "source", F.row_number().over(order).alias("place"))
    some = placed.where((F.col("place") <= samples) & (F.col("status") != UNCHANGED)).groupBy("user_id", "status").agg(F.array_sort(F.collect_list("source")).alias("sample"))
    counts = classified.groupBy("user_id", "status").agg(F.count(F.lit(1)).alias("n_files"))
    return counts.join(some, ["user_id", "status"], "left").withColumn("sample", F.array_join(F.coalesce("sample", F.array().cast("array<string>")), "|"))


def delete_sources(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """The chunks whose (user_id, source) is not in ``gone``."""
    return chunks.join(gone.select(*FILE).distinct(), FILE, "left_anti")


def deletion_report(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """(user_id, source, n_deleted) of every requested deletion; 0 where nothing matched."""
    counts = chunks.groupBy(*FILE).agg(F.count(F.lit(1)).alias("n"))
    return gone.select(*FILE).distinct().join(counts, FILE, "left").select(*FILE, F.coalesce("n", F.lit(0)).alias("n_deleted"))


def replace_modified(chunks: DataFrame, fresh: DataFrame, failed: DataFrame | None = None, modified: DataFrame | None = None) -> DataFrame:
    """The chunk table with ``fresh`` chunks in place of older ones of their sources.

    Rows of other hashes go, rows without a hash stay. Sources in ``failed`` keep their rows and store none of
    ``fresh``. ``modified`` (user_id, source, content_hash) names sources that were processed, so one that now
    gives no chunk loses its old rows too.
    """
    if failed is not None:
        fresh = fresh.join(failed.select(*FILE).distinct(), FILE, "left_anti")
    names = fresh.select(*FILE, F.col("content_hash").alias("new_hash"))
    if modified is not None:
        extra = modified.select(*FILE, F.col("content_hash").alias("new_hash"))
        names = names.unionByName(extra if failed is None else extra.join(failed.select(*FILE).distinct(), FILE, "left_anti"))
    done = names.distinct()
    stale = (chunks["user_id"] == done["user_id"]) & (chunks["source"] == done["source"]) & (chunks["content_hash"] != done["new_hash"])
    return chunks.join(done, stale, "left_anti").unionByName(fresh, allowMissingColumns=True)


def append_all(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """A full run without comparison: a repeated run stores its rows again."""
    return chunks.unionByName(fresh, allowMissingColumns=True)


def complete_sources(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split helper output with an ``error`` column into rows of sources without any error, and (user_id, source, error)."""
    failed = rows.where("error IS NOT NULL").groupBy(*FILE).agg(F.min("error").alias("error"))
    return rows.join(failed, FILE, "left_anti").drop("error"), failed


def upsert_users(users: DataFrame, incoming: DataFrame) -> DataFrame:
    """``users`` with the (name, api_key) of ``incoming`` whose key is new; known keys keep their row.

    Ids go on from the highest one in the order of keys. Ranks are counted per range of keys and shifted by
    the sizes of the ranges before, so no task sees all new users.
    """
    fresh = incoming.groupBy("api_key").agg(F.min("name").alias("name")).join(users, "api_key", "left_anti")
    ranges = 64
    dealt = fresh.withColumn("_range", F.pmod(F.xxhash64("api_key"), F.lit(ranges)))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    start = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    top = users.agg(F.max("id")).first()[0] or 0
    offsets = sizes.withColumn("_start", F.coalesce(start, F.lit(0)) + F.lit(top)).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("api_key"))
    added = dealt.withColumn("_rank", rank).join(F.broadcast(offsets), "_range").select((F.col("_start") + F.col("_rank")).alias("id"), "name", "api_key")
    return users.select("id", "name", "api_key").unionByName(added)


def user_ids(users: DataFrame, keys: DataFrame) -> DataFrame:
    """(api_key, id) of the wanted keys; null for an unknown one."""
    return keys.select("api_key").distinct().join(users.select("api_key", "id"), "api_key", "left")


def cascade_delete(chunks: DataFrame, users: DataFrame) -> DataFrame:
    """The chunks of users that exist."""
    return chunks.join(users.select(F.col("id").alias("user_id")).distinct(), "user_id", "left_semi").select(*chunks.columns)


def chunk_rows(rows: DataFrame) -> DataFrame:
    """The stored columns in their types, null where ``rows`` lacks one."""
    kinds = {f.name: f.dataType for f in T.StructType.fromDDL(CHUNKS).fields}
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in CHUNK_COLUMNS])
