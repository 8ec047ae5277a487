"""Tables put into a foreign database over JDBC: written side by side to a staging table, then put in place by one transaction.

A batch is put in place once. The transaction that moves its rows also enters its number in a table of loads, so a
batch that is sent again, by a retry or by hand, adds nothing. Tasks that Spark repeats may write their rows twice: each row
carries a number, and the staging table is taken only if it holds every number once; otherwise it is written anew.
A write that breaks on the way leaves the rows of before.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import attempts, name, text
from .tables import written

#: Which batches have been put into which tables, and how many rows each brought.
LOADS = "loads"
#: The column by which rows of the staging table are told apart.
ROW = "staged_row"
MODES = ("replace", "add")


class StagedRowsDiffer(PySparkException):
    """The staging table does not hold each row once."""


def _writer(df: DataFrame, url: str, table: str):  # noqa: ANN202
    return df.write.format("jdbc").option("url", url).option("dbtable", table).option("isolationLevel", "READ_COMMITTED")


def _one(spark: SparkSession, url: str, query: str):  # noqa: ANN202
    return spark.read.format("jdbc").option("url", url).option("query", query).load().first()


@contextmanager
def transaction(spark: SparkSession, url: str):  # noqa: ANN201
    """A function that runs statements, committed together at the end or not at all. The driver class is the one that
    Spark has loaded for the writes before."""
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        yield statement.executeUpdate
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def ensure_loads(spark: SparkSession, url: str, schema: str) -> None:
    """Makes the table of loads where there is none; its key keeps a batch from being entered twice."""
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        known = connection.getMetaData().getTables(None, schema, LOADS, None).next()
    finally:
        connection.close()
    if not known:
        table, batch, n = map(name, ("table_name", "batch", "n_rows"))
        with transaction(spark, url) as run:
            run(f"CREATE TABLE {name(schema, LOADS)} ({table} VARCHAR(128) NOT NULL, {batch} VARCHAR(128) NOT NULL, {n} BIGINT, PRIMARY KEY ({table}, {batch}))")


def loaded(spark: SparkSession, url: str, schema: str, table: str, batch: str) -> int | None:
    """Rows that a batch brought; None if it has not been put in place."""
    found = _one(spark, url, f"SELECT {name('n_rows')} AS n FROM {name(schema, LOADS)} WHERE {name('table_name')} = {text(table)} AND {name('batch')} = {text(batch)}")
    return None if found is None else int(found[0])


def _stage(rows: DataFrame, n: int, url: str, staging: str, parts: int, batch_size: int) -> None:
    """`parts` connections write at once, each in a transaction for its part."""
    _writer(rows, url, staging).mode("overwrite").option("numPartitions", parts).option("batchsize", batch_size).save()
    held = _one(rows.sparkSession, url, f"SELECT COUNT(*) AS n, COUNT(DISTINCT {name(ROW)}) AS d FROM {staging}")
    if tuple(map(int, held)) != (n, n):
        raise StagedRowsDiffer(f"{staging} holds {held[0]} rows with {held[1]} numbers, not {n}")


def put(
    df: DataFrame, url: str, schema: str, table: str, batch: str, *, mode: str = "replace", parts: int = 16, batch_size: int = 5000, pause: float = 5.0,
    between: Callable[[], None] = lambda: None,
) -> int:
    """Puts the rows of df into schema.table, in place of its rows or beside them, and returns how many the batch brought.

    The table is made if it is missing, and so is the table of loads. A batch that is in place already changes nothing, whatever
    df holds. An empty df is a batch, too. Names are given in standard quotes. Two batches for the same table at once have staging
    tables of their own; which one replaces the other is the database's order of transactions. `between` is called when
    the rows are staged and have not been put in place."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if ROW in df.columns:
        raise ValueError(f"a column is named {ROW}, as the numbers of staged rows are")
    spark, target, staging = df.sparkSession, name(schema, table), name(schema, f"{table}_{batch}_staging")
    _writer(df.limit(0), url, target).mode("ignore").save()
    ensure_loads(spark, url, schema)
    before = loaded(spark, url, schema, table, batch)
    if before is not None:
        return before
    # Numbers follow the files of a written table, so a task that is repeated gives its rows the same ones.
    rows = written(df)
    rows, n = rows.withColumn(ROW, F.monotonically_increasing_id()), rows.count()
    attempts(lambda: _stage(rows, n, url, staging, parts, batch_size), pause=pause)
    between()
    columns = ", ".join(map(name, df.columns))
    with transaction(spark, url) as run:
        run(f"INSERT INTO {name(schema, LOADS)} VALUES ({text(table)}, {text(batch)}, {n})")
        if mode == "replace":
            run(f"DELETE FROM {target}")
        run(f"INSERT INTO {target} ({columns}) SELECT {columns} FROM {staging}")
    with transaction(spark, url) as run:
        run(f"DROP TABLE {staging}")
    return n
