"""Tables bucketed and sorted by their join keys: two of them with as many buckets meet in a merge join without a shuffle.

They lie in the shared folder of ``scratch`` (or where they are told to) and are known to the session's catalogue by a name of their own.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from docloom.sources.scratch import delete_path, new_path, settings

#: With it a scan of one file to a bucket is known to be in the order it was written in.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@dataclass(frozen=True)
class SortedTable:
    spark: SparkSession
    name: str
    path: str
    buckets: int

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def plain(self) -> DataFrame:
        """The rows without their buckets. A union of bucketed scans must read them so: Spark 4.1 takes the buckets of a union for aligned, groups without a shuffle, and gives wrong groups."""
        return self.spark.read.schema(self.read().schema).parquet(self.path)

    def discard(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_path(self.spark, self.path)


def write_sorted(rows: DataFrame, label: str, keys: list[str], order: list[str], buckets: int, dealt: bool = False, path: str | None = None) -> SortedTable:
    """Write ``rows`` dealt into ``buckets`` by ``keys``, each bucket one file in the order of ``order``.

    ``dealt`` says that a join or grouping by the keys with as many partitions has dealt the rows already.
    """
    spark = rows.sparkSession
    table = SortedTable(spark, f"docloom_{label.replace('-', '_')}_{uuid.uuid4().hex}", path or new_path(spark, label), buckets)
    spread = rows if dealt else rows.repartition(buckets, *keys)
    spread.write.format("parquet").option("path", table.path).bucketBy(buckets, *keys).sortBy(*order).saveAsTable(table.name)
    return table


def ordered_scans(spark: SparkSession):
    """Plans that run inside rely on the order of sorted tables."""
    return settings(spark, **{ORDERED: "true"})
