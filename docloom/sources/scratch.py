"""Tables that a job writes for itself, in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where the setting is absent and one machine runs everything (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/docloom-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, partition_by: str | None = None, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors. ``discard`` deletes it."""
    path = new_path(df.sparkSession, label)
    writer = df.write.options(**options)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.scratch_path = path
    return read


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """``values`` (dots in names as two underscores) hold for what runs inside; the session's own come back afterwards."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``; no rows where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def path_exists(spark: SparkSession, where: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


def delete_path(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def discard(*written: DataFrame) -> None:
    """Delete tables of ``materialise`` that later ones have replaced, and what shuffles wrote for jobs that are done; nothing may read the tables any more."""
    for df in written:
        delete_path(df.sparkSession, df.scratch_path)
    if written:
        drop_shuffles(written[0].sparkSession)


def drop_shuffles(spark: SparkSession) -> None:
    """Spark deletes the files of a shuffle once the driver has collected what refers to it, which a driver with memory to spare does late or never: so it collects now."""
    gc.collect()
    spark._jvm.System.gc()
