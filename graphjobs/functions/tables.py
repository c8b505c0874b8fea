"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a new one on a local master (as in
    tests), and an error on a cluster, whose machines don't share a folder of the driver's."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path there that nothing uses yet; inside ``scratch`` its files go at the end."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df there and read it back: cuts lineage, and gives the optimiser true sizes."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the cluster's library."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    fs, p = hadoop_path(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that are made inside once it ends; what is to stay has been written elsewhere by then."""
    token = _made.set([])
    try:
        yield
    finally:
        for path in _made.get():
            fs, p = hadoop_path(spark, path)
            fs.delete(p, True)
        _made.reset(token)


@contextmanager
def bucketed(df: DataFrame, key: str, name: str = "buckets") -> Iterator[DataFrame]:
    """df written in buckets of ``key``, one file each, as many as there are shuffle partitions: joins and groups by the key
    read it without an exchange. The table, in the shared folder, lasts as long as the block."""
    spark = df.sparkSession
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    path = new_path(spark, name)
    dealt = df.repartition(n, key).sortWithinPartitions(key)
    dealt.write.bucketBy(n, key).sortBy(key).format("parquet").option("path", path).saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        fs, p = hadoop_path(spark, path)
        fs.delete(p, True)
