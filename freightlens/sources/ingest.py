"""Reading a foreign database over JDBC and landing it: types, options, sinks, settings, and the job over all tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, fields
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import file_system, remove

# Type names of the source database and what they are read as.
_PLAIN = {
    "int": T.IntegerType(), "bigint": T.LongType(), "smallint": T.ShortType(), "tinyint": T.ShortType(), "bit": T.BooleanType(), "float": T.DoubleType(), "real": T.FloatType(),
    "date": T.DateType(), "datetime": T.TimestampNTZType(), "smalldatetime": T.TimestampNTZType(), "datetime2": T.TimestampNTZType(), "varbinary": T.BinaryType(), "binary": T.BinaryType(), "image": T.BinaryType(),
}
_DECIMAL = ("decimal", "numeric", "money", "smallmoney")


def map_type(name: str, precision: int | None = None, scale: int | None = None) -> T.DataType:
    """Any name in any case has a type; unknown ones, times and ids are strings."""
    name = name.lower()
    if name in _DECIMAL:
        return T.DecimalType(38, 18) if precision is None or scale is None else T.DecimalType(precision, scale)
    return _PLAIN.get(name, T.StringType())


@dataclass(frozen=True)
class Settings:
    url: str
    schema: str
    target: str
    fetch_size: int = 5000
    truncate_before_load: bool = True
    #: Asks a source of another kind for its own estimate of a table's rows; {schema} and {table} stand for quoted text.
    estimate_query: str = ""

    @classmethod
    def of(cls, given: Mapping) -> Settings:
        """Raises one error that names every missing field."""
        missing = [f.name for f in fields(cls) if f.name in ("url", "schema", "target") and not given.get(f.name)]
        if missing:
            raise ValueError("missing settings: " + ", ".join(missing))
        return cls(**{f.name: given[f.name] for f in fields(cls) if f.name in given})

    @classmethod
    def read(cls, path: str) -> Settings:
        import yaml

        return cls.of(yaml.safe_load(Path(path).read_text()) or {})


def name(*parts: str) -> str:
    """Parts of a name in standard quotes."""
    return ".".join('"' + p.replace('"', '""') + '"' for p in parts)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def table_reader(spark: SparkSession, s: Settings, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 64) -> DataFrameReader:
    """A JDBC reader of one table; with a numeric key and its bounds, in `parts` ranges side by side."""
    r = spark.read.format("jdbc").option("url", s.url).option("dbtable", name(s.schema, table)).option("fetchsize", s.fetch_size)
    if key and bounds:
        r = r.option("partitionColumn", name(key)).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return r


def columns_query(schema: str, table: str) -> str:
    return f"""SELECT COLUMN_NAME, DATA_TYPE, CHARACTER_MAXIMUM_LENGTH, NUMERIC_PRECISION, NUMERIC_SCALE, IS_NULLABLE, ORDINAL_POSITION
FROM INFORMATION_SCHEMA.COLUMNS WHERE TABLE_SCHEMA = {text(schema)} AND TABLE_NAME = {text(table)}"""


def tables_query(schema: str) -> str:
    return f"SELECT TABLE_NAME FROM INFORMATION_SCHEMA.TABLES WHERE TABLE_TYPE = 'BASE TABLE' AND TABLE_SCHEMA = {text(schema)}"


def count_query(schema: str, table: str) -> str:
    """The source's own estimate of a table's rows, from its catalog and without a scan."""
    return f"""SELECT SUM(p.rows) AS n FROM sys.partitions p JOIN sys.objects o ON o.object_id = p.object_id JOIN sys.schemas s ON s.schema_id = o.schema_id
WHERE s.name = {text(schema)} AND o.name = {text(table)} AND p.index_id IN (0, 1)"""


def query_reader(spark: SparkSession, s: Settings, query: str) -> DataFrameReader:
    return spark.read.format("jdbc").option("url", s.url).option("query", query)


def tables_of(spark: SparkSession, s: Settings) -> list[str]:
    return sorted(r[0] for r in query_reader(spark, s, tables_query(s.schema)).load().collect())


def schema_of(spark: SparkSession, s: Settings, table: str) -> T.StructType:
    """A table's columns in their order, from the source's catalog."""
    found = query_reader(spark, s, columns_query(s.schema, table)).load().collect()
    return struct_of(sorted((r.asDict() for r in found), key=lambda c: c["ORDINAL_POSITION"]))


def estimate(spark: SparkSession, s: Settings, table: str) -> int | None:
    """None where the source does not tell."""
    try:
        asked = s.estimate_query.format(schema=text(s.schema), table=text(table)) if s.estimate_query else count_query(s.schema, table)
        found = query_reader(spark, s, asked).load().first()
        return None if found is None or found[0] is None else int(found[0])
    except (Py4JError, PySparkException):
        return None


def bounds_of(spark: SparkSession, s: Settings, table: str, key: str) -> tuple[int, int] | None:
    """Least and greatest value of a numeric key; None for an empty table."""
    low, high = query_reader(spark, s, f"SELECT MIN({name(key)}) AS lo, MAX({name(key)}) AS hi FROM {name(s.schema, table)}").load().first()
    return None if low is None else (int(low), int(high) + 1)


def struct_of(columns: Iterable[Mapping]) -> T.StructType:
    """The schema that the rows of columns_query describe."""
    return T.StructType([T.StructField(c["COLUMN_NAME"], map_type(c["DATA_TYPE"], c["NUMERIC_PRECISION"], c["NUMERIC_SCALE"]), c["IS_NULLABLE"] == "YES") for c in columns])


def materialized(df: DataFrame, path: str, name: str) -> DataFrame:
    """df written in place of what `path` held, and registered as the view `name`."""
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.createOrReplaceTempView(name)
    return out


def land(df: DataFrame, path: str, truncate: bool = True) -> None:
    df.write.mode("overwrite" if truncate else "append").parquet(path)


def add_load(df: DataFrame, path: str, load: str) -> int:
    """Adds df to what `path` holds, as files that bear the load's name; returns its rows. The same load done again takes the
    place of what an attempt before it has left, so a retry doubles nothing. Rows are counted from what was written."""
    spark, staged = df.sparkSession, f"{path}/_load-{load}"
    df.write.mode("overwrite").parquet(staged)
    n = spark.read.schema(df.schema).parquet(staged).count()
    fs, to = file_system(spark, path)
    for s in fs.listStatus(to):
        if s.getPath().getName().startswith(f"{load}-"):
            fs.delete(s.getPath(), False)
    for s in fs.listStatus(file_system(spark, staged)[1]):
        if (file := s.getPath().getName()).startswith("part-") and not fs.rename(s.getPath(), file_system(spark, f"{path}/{load}-{file}")[1]):
            raise PySparkException(f"{file} of load {load} could not be put into {path}")
    remove(spark, staged)
    return n


def land_csv(df: DataFrame, path: str, truncate: bool = True) -> None:
    """Nulls as \\N, bytes as \\x and hex digits."""
    binary = [f.name for f in df.schema if isinstance(f.dataType, T.BinaryType)]
    df = df.withColumns({c: F.concat(F.lit("\\x"), F.lower(F.hex(c))) for c in binary})
    df.write.mode("overwrite" if truncate else "append").option("nullValue", "\\N").option("header", True).csv(path)


def attempts(work: Callable[[], object], tries: int = 3, pause: float = 5.0) -> object:
    """work, done again after a pause if it fails, `tries` times in all."""
    for left in range(tries - 1, -1, -1):
        try:
            return work()
        except (Py4JError, PySparkException):
            if not left:
                raise
            time.sleep(pause)


def copy(spark: SparkSession, s: Settings, table: str, parts: int = 64, load: str = "") -> int:
    """Lands one table with the types of its catalog, in ranges of its first whole-number column; returns the rows of
    this load. Where the target is not truncated, a load of the same name replaces its own rows only."""
    schema = schema_of(spark, s, table)
    key = next((f.name for f in schema if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType)) and not f.nullable), None)
    rows = table_reader(spark, s, table, key, bounds_of(spark, s, table, key) if key else None, parts).load()
    rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
    path = f"{s.target}/{table}"
    if not s.truncate_before_load:
        return add_load(rows, path, load or uuid.uuid4().hex)
    land(rows, path)
    return spark.read.schema(rows.schema).parquet(path).count()


def run(spark: SparkSession, s: Settings, pause: float = 5.0) -> DataFrame:
    """Copies every table of the schema. Per table: the source's estimate, the rows landed, status, error, seconds.
    A table that fails three times does not keep the others from being copied."""
    done, load = [], uuid.uuid4().hex
    for table in tables_of(spark, s):
        begin, rows, error = time.monotonic(), None, None
        try:
            rows = attempts(lambda: copy(spark, s, table, load=load), pause=pause)  # noqa: B023
        except (Py4JError, PySparkException) as e:
            error = str(e)[:500]
        done.append((table, estimate(spark, s, table), rows, "FAILED" if error else "SUCCESS", error, time.monotonic() - begin))
    return spark.createDataFrame(done, "table string, estimate bigint, rows bigint, status string, error string, seconds double")
