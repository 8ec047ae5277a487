"""Tables written between steps, and their removal."""

from pathlib import Path

from pyspark.sql import functions as F

from freightlens.llm import common
from freightlens.llm.common import CLEANUP, discard, in_memory, materialize, scratch


def test_tables_come_and_go(spark):
    root = Path(scratch(spark).removeprefix("file:"))
    before = spark.conf.get(CLEANUP, "false")
    df = spark.range(100).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    table, other = materialize(df), materialize(df.limit(0))
    assert spark.conf.get(CLEANUP) == before
    assert sorted(table.collect()) == sorted(df.collect()) and other.count() == 0 and other.dtypes == df.dtypes
    steps = lambda: {p.name for p in root.glob("step-*")}
    held = steps()
    discard(table, other)
    assert len(held - steps()) == 2


def test_only_own_tables_go(spark, tmp_path):
    path = tmp_path / "kept"
    spark.range(3).write.parquet(str(path))
    discard(spark.read.parquet(str(path)))
    assert spark.read.parquet(str(path)).count() == 3


def test_only_small_sides_are_held_in_memory(spark, monkeypatch):
    rows = spark.range(2000).withColumn("k", F.col("id") % 100)
    side = materialize(spark.range(50).withColumnRenamed("id", "k"))
    want = sorted(rows.join(side, "k").collect())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for limit, hinted in ((64 << 20, True), (0, False)):
        monkeypatch.setattr(common, "HELD", limit)
        joined = rows.join(in_memory(side, 8), "k")
        assert ("shuffle_hash" in plan(joined)) == hinted and sorted(joined.collect()) == want
    discard(side)
