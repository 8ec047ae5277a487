"""Parquet tables: steps written once, tables made where they are missing."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where it is unset and the
    executors are this process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="freightlens-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def file_system(spark: SparkSession, path: str):  # noqa: ANN202
    """The Hadoop file system of a path, and the path as it takes it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def written(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """df written to the shared folder and read back, so that what follows neither computes it again nor holds it
    in memory. The folder goes when the application ends."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """As `written`, in buckets by the hash of `key`: joins with others of as many buckets and groups by the key, alone or with
    more columns, move no row, and a task reads one bucket."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files are those of `path`
    return out


@contextlib.contextmanager
def one_key_suffices(spark: SparkSession) -> Iterator[None]:
    """While it lasts, jobs join tables that lie in buckets by one of several join keys where they lie."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bytes_of(df: DataFrame) -> int:
    """Size of the files that a table just read consists of."""
    total = 0
    for f in df.inputFiles():
        fs, p = file_system(df.sparkSession, f)
        total += fs.getFileStatus(p).getLen()
    return total


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table, n_rows: of Parquet tables just read. No column is asked for, so Spark takes the numbers from the files' footers,
    each task those of its files, and reads none of the data."""
    each = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows") for name, df in tables.items()]
    return functools.reduce(DataFrame.unionByName, each)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The table at `path`, without rows before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def ensure_table(spark: SparkSession, name: str, schema: T.StructType | str, partition_by: Sequence[str] = (), bucket_by: Sequence[str] = (), buckets: int = 64) -> None:
    """Makes a catalog table, and its database, where there is none. Buckets take the place of an index on a key:
    joins and upserts on it need no shuffle of this side."""
    if "." in name:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name.split('.')[0]}`")
    writer = spark.createDataFrame([], schema).write.format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    writer.mode("ignore").saveAsTable(name)
