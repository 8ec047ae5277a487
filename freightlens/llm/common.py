"""Helpers that several training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import bytes_of, remove
from ..sources.tables import shared_folder as scratch

#: A word is a longest run of bytes other than space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Spark's setting by which the shuffle files of a finished query go at once, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: a lost executor re-reads it, and later
    steps do not compute it again. Its own shuffle files are not needed then and go at once. The folder
    goes with `discard`, or when the application ends."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/step-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a side's files, for each part that its keys spread over, up to which a join holds that side in memory.
HELD = 64 << 20


def in_memory(df: DataFrame, parts: int = 1) -> DataFrame:
    """A written side of a join, to be held in memory by its tasks where its files are small enough for that; a larger one
    is sorted like any other, and spills. parts: shuffle partitions over which its keys spread evenly, 1 if one key may have most rows."""
    return df.hint("shuffle_hash") if bytes_of(df) <= HELD * parts else df


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `materialize` wrote and that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if path.rpartition("/")[2].startswith("step-"):
                remove(spark, path)


def key_hash(key: Column) -> Column:
    """62 bits of a key's hash."""
    return F.xxhash64(key).bitwiseAND(F.lit(2**62 - 1))


def hash_limit(most: int, n: int) -> int:
    """About `most` of n keys have a `key_hash` below it. It stays above 0 up to some 10**18 times more keys than are wanted."""
    return min(2**62, most * 2**62 // max(1, n))


def hashed_share(key: Column, most: int, n: int) -> Column:
    """True for the rows of about `most` of `n` keys, the same ones each time."""
    return key_hash(key) < F.lit(hash_limit(most, n))


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with `value` computed once, though body may name it within lambdas and often."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op) -> Column:  # noqa: ANN001
    """op.reduce over each beginning of an array, for an associative op: n log n steps, where a fold that appends
    to an array copies it each time. Pass k joins each item with the one 2**k before it."""
    passes = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int") - 1))

    def step(acc: Column, k: Column) -> Column:
        back = F.pow(F.lit(2), k).cast("int")
        return F.transform(acc, lambda x, i: F.when(i >= back, op(F.get(acc, i - back), x)).otherwise(x))

    return F.aggregate(passes, values, step)


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) with 52 random bits that depends on seed and key alone."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return (bits.cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(2**52))
