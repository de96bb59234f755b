"""A cache table bucketed by digest: look-ups shuffle what is asked, never what is stored.

The table at ``path`` is made known to the session under a name of its own with its number of buckets, which is part of the path's
meaning and must stay. Each growth adds a file to every bucket; ``compact`` makes them one again, sorted, which saves the join its sort.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import cache
from docloom.sources.scratch import discard, materialise


@dataclass(frozen=True)
class BucketedCache:
    """``columns``: what is stored beside the digest. As many buckets as a shuffle has partitions at least, so that Spark deals the questions to them."""

    spark: SparkSession
    path: str
    columns: str = "embedding array<float>"
    buckets: int = 200

    @property
    def name(self) -> str:
        return f"docloom_cache_{hashlib.sha256(f'{self.path}|{self.columns}|{self.buckets}'.encode()).hexdigest()[:16]}"

    def read(self) -> DataFrame:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, {self.columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        return self.spark.table(self.name)

    def look_up(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with digest) with what is stored of their digest and ``hit``."""
        stored = self.read().withColumn("hit", F.lit(True))
        return rows.join(stored.hint("merge"), "digest", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))

    def misses(self, rows: DataFrame, content: str) -> DataFrame:
        """(digest, content) once for each content that is not stored; only digests meet the table."""
        missing = rows.select("digest").distinct().join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        return cache.distinct_contents(rows.join(missing, "digest", "left_semi"), content)

    def add(self, made: DataFrame) -> None:
        """Store what of ``made`` (digest and the columns) is not stored yet; of several rows of a digest one."""
        columns = [c for c in self.read().columns if c != "digest"]
        once = made.groupBy("digest").agg(*[F.any_value(c).alias(c) for c in columns])
        fresh = once.join(self.read().select("digest").hint("merge"), "digest", "left_anti").select("digest", *columns)
        written = materialise(fresh, "cache-rows")  # a repeated task must not see its own rows
        written.repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        discard(written)

    def compact(self) -> None:
        """One sorted file to a bucket; nothing may read the table meanwhile."""
        rows = materialise(self.read(), "cache-compact")
        rows.repartition(self.buckets, "digest").write.insertInto(self.name, overwrite=True)
        self.spark.catalog.refreshTable(self.name)
        discard(rows)
