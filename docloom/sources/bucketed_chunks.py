"""A chunk table of two levels, user and bucket: what changes in a few files rewrites their buckets, not the user.

A source lies in the bucket that its hash names among the buckets of its user. Their number is set when the user first
has rows, by how many these are, and stays; it is kept in a table of its own at ``<table>-buckets``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import incremental
from docloom.schemas import CHUNKS
from docloom.sources.scratch import delete_path, discard, materialise, read_or_empty

ROWS_PER_BUCKET = 200_000
SIZES = "user_id int, n_buckets int"
FILE = ["user_id", "source"]
#: So many changed partitions become a filter on the table; of more only the users do.
LISTED = 1000


def bucket(source: Column, n: Column) -> Column:
    """The bucket of a source: the first 32 bits of its SHA-256 modulo ``n``."""
    return F.pmod(F.conv(F.substring(F.sha2(source.cast("binary"), 256), 1, 8), 16, 10).cast("bigint"), n.cast("bigint")).cast("int")


@dataclass(frozen=True)
class BucketedChunks:
    spark: SparkSession
    path: str
    rows_per_bucket: int = ROWS_PER_BUCKET
    schema: str = CHUNKS

    def sizes(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.path.rstrip('/')}-buckets", SIZES)

    def read(self) -> DataFrame:
        """All rows, with the bucket; filters on user and bucket prune partitions."""
        return read_or_empty(self.spark, self.path, f"{self.schema}, bucket int")

    def new_sizes(self, rows: DataFrame) -> DataFrame:
        """The numbers of buckets of users in ``rows`` that have none yet. The known ones are broadcast: a shuffle by user would bring all rows of a user to one task."""
        buckets = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / self.rows_per_bucket)).cast("int").alias("n_buckets")
        return rows.groupBy("user_id").agg(buckets).join(F.broadcast(self.sizes()), "user_id", "left_anti")

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their bucket, in files of their bucket; users without a number of buckets get one by their rows."""
        fresh = materialise(self.new_sizes(rows), "bucket-sizes")
        fresh.write.mode("append").parquet(f"{self.path.rstrip('/')}-buckets")
        discard(fresh)
        return rows.join(F.broadcast(self.sizes()), "user_id").withColumn("bucket", bucket(F.col("source"), F.col("n_buckets"))).drop("n_buckets")

    def append(self, rows: DataFrame) -> None:
        self.placed(rows).repartition("user_id", "bucket").write.mode("append").partitionBy("user_id", "bucket").parquet(self.path)

    def update(self, fresh: DataFrame, modified: DataFrame | None = None, gone: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
        """Put ``fresh`` chunks in place of older ones of their sources and take the sources in ``gone`` out, as ``replace_modified`` and ``delete_sources`` do.

        Only the partitions of a changed source are read, staged and overwritten; those that are left empty go. Gives (user_id, bucket, n_rows) of what was rewritten.
        """
        none = self.spark.createDataFrame([], "user_id int, source string")
        names = [f.select(*FILE) for f in (fresh, modified, gone) if f is not None]
        changed = none
        for part in names:
            changed = changed.unionByName(part)
        changed = materialise(self.placed(changed.distinct()), "changed-sources")
        touched = changed.select("user_id", "bucket").distinct()
        old = self.partitions(touched)
        kept = old if gone is None else incremental.delete_sources(old, gone)
        now = incremental.replace_modified(kept.drop("bucket"), fresh, failed, modified)
        sized = now.join(F.broadcast(self.sizes()), "user_id").withColumn("bucket", bucket(F.col("source"), F.col("n_buckets"))).drop("n_buckets")
        staged = materialise(sized.repartition("user_id", "bucket"), "staged-buckets")
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("user_id", "bucket").parquet(self.path)
        written = staged.groupBy("user_id", "bucket").agg(F.count(F.lit(1)).alias("n_rows"))
        report = materialise(touched.join(written, ["user_id", "bucket"], "left").select("user_id", "bucket", F.coalesce("n_rows", F.lit(0)).alias("n_rows")), "rewritten")
        for row in report.where("n_rows = 0").toLocalIterator():
            delete_path(self.spark, f"{self.path}/user_id={row.user_id}/bucket={row.bucket}")
        discard(staged, changed)
        return report

    def partitions(self, touched: DataFrame) -> DataFrame:
        """The rows of some partitions (user_id, bucket); the others are not read."""
        some = touched.limit(LISTED + 1).collect()
        rows = self.read()
        if len(some) > LISTED:
            return rows.join(F.broadcast(touched), ["user_id", "bucket"], "left_semi").select(*rows.columns)
        by_user: dict[int, list[int]] = {}
        for r in some:
            by_user.setdefault(r.user_id, []).append(r.bucket)
        condition = F.lit(False)
        for user, buckets in by_user.items():
            condition |= (F.col("user_id") == user) & F.col("bucket").isin(buckets)
        return rows.where(condition)
