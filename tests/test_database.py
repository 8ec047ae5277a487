"""Tables put into a database in this process: broken writes, repeated batches, repeated tasks; counts from footers."""

import os

import pytest
from pyspark.sql import functions as F

from freightlens import jobs
from freightlens.plans import catalogue
from freightlens.sources import database, ingest
from freightlens.sources.shipments import from_orders

URL = "jdbc:derby:memory:sink"
SCHEMA = "graph"


@pytest.fixture(scope="module")
def url(spark, tmp_path_factory):
    spark._jvm.System.setProperty("derby.system.home", str(tmp_path_factory.mktemp("derby")))
    spark._jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    connection = spark._jvm.java.sql.DriverManager.getConnection(f"{URL};create=true")
    connection.createStatement().execute(f'CREATE SCHEMA "{SCHEMA}"')
    connection.close()
    return URL


def rows_of(spark, url, table):
    return spark.read.format("jdbc").option("url", url).option("dbtable", ingest.name(SCHEMA, table)).load()


def tables_in(spark, url):
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    found, out = connection.getMetaData().getTables(None, SCHEMA, None, None), set()
    while found.next():
        out.add(found.getString("TABLE_NAME"))
    connection.close()
    return out


def frame(spark, ids):
    """Quotes, nulls, repeated rows, a name with a quote and a clashing one."""
    return spark.createDataFrame([(i, None if i % 3 == 0 else f"it's {i}", i / 4, i) for i in ids for _ in range(2)], "id long, `o'clock` string, tons double, batch long").repartition(5)


def test_batches_replace_and_add_once(spark, url):
    first = frame(spark, range(30))
    assert database.put(first, url, SCHEMA, "lines", "1", parts=3) == 60
    assert sorted(map(tuple, rows_of(spark, url, "lines").collect()), key=str) == sorted(map(tuple, first.collect()), key=str)
    # The batch again, whatever it holds, changes nothing.
    assert database.put(frame(spark, range(5)), url, SCHEMA, "lines", "1", mode="add") == 60
    assert rows_of(spark, url, "lines").count() == 60
    for _ in range(2):
        assert database.put(frame(spark, range(30, 40)), url, SCHEMA, "lines", "2", mode="add") == 20
    assert rows_of(spark, url, "lines").agg(F.count("*"), F.sum("id")).first()[:] == (80, 2 * sum(range(40)))
    assert database.put(frame(spark, range(4)), url, SCHEMA, "lines", "3") == 8
    assert rows_of(spark, url, "lines").count() == 8
    assert database.put(first.limit(0), url, SCHEMA, "lines", "4") == 0 and rows_of(spark, url, "lines").count() == 0
    assert {t for t in tables_in(spark, url) if "staging" in t} == set()
    with pytest.raises(ValueError, match="mode"):
        database.put(first, url, SCHEMA, "lines", "5", mode="other")
    with pytest.raises(ValueError, match=database.ROW):
        database.put(first.withColumn(database.ROW, F.lit(1)), url, SCHEMA, "lines", "5")


def test_a_broken_write_leaves_the_old_rows(spark, url):
    old = frame(spark, range(10))
    database.put(old, url, SCHEMA, "kept", "1")

    def broken():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        database.put(frame(spark, range(50)), url, SCHEMA, "kept", "2", between=broken)
    assert rows_of(spark, url, "kept").count() == 20 and database.loaded(spark, url, SCHEMA, "kept", "2") is None
    # A transaction that fails at its last statement takes the deletion and the entry back.
    with pytest.raises(Exception, match="missing"), database.transaction(spark, url) as run:
        run(f"INSERT INTO {ingest.name(SCHEMA, database.LOADS)} VALUES ('kept', '2', 1)")
        run(f"DELETE FROM {ingest.name(SCHEMA, 'kept')}")
        run(f"INSERT INTO {ingest.name(SCHEMA, 'kept')} SELECT * FROM {ingest.name(SCHEMA, 'missing')}")
    assert rows_of(spark, url, "kept").count() == 20 and database.loaded(spark, url, SCHEMA, "kept", "2") is None
    # Another try of the batch writes over what was staged.
    assert database.put(frame(spark, range(50)), url, SCHEMA, "kept", "2") == 100 == rows_of(spark, url, "kept").count()


def test_rows_staged_twice_are_staged_anew(spark, url, monkeypatch):
    calls, stage = [], database._stage

    def twice(rows, n, *given):
        """The first time, some of the tasks write their rows twice."""
        calls.append(n)
        stage(rows.unionByName(rows.filter("id < 3")) if len(calls) == 1 else rows, n, *given)

    monkeypatch.setattr(database, "_stage", twice)
    assert database.put(frame(spark, range(10)), url, SCHEMA, "twice", "1", pause=0.0) == 20
    assert calls == [20, 20] and rows_of(spark, url, "twice").count() == 20


def test_export_of_a_build(spark, url, tmp_path):
    root = str(tmp_path / "root")
    orders = from_orders(spark, "/root/testdata/sf0.001")
    jobs.build_graph(spark, orders, root)
    jobs.build_views(spark, orders, root)
    want = {r.table: r["rows"] for r in jobs.export(spark, root, url, SCHEMA, "b1", pause=0.0).collect()}
    assert want["nodes"] > 0 and want["edges_gf"] > 0 and want["simple_train_view"] > 0 and len(want) == 10
    assert {r.table: r["rows"] for r in jobs.export(spark, root, url, SCHEMA, "b1", pause=0.0).collect()} == want
    assert {t: rows_of(spark, url, t).count() for t in want} == want
    a, b = (df.agg(F.count("*"), F.sum("graph_node_id")).first()[:] for df in (rows_of(spark, url, "nodes"), jobs.quarters.latest(spark, root, "nodes")[1]))
    assert a == b


def test_estimates_of_another_source(spark, url):
    with database.transaction(spark, url) as run:
        run(f'CREATE TABLE "{SCHEMA}"."stats" ("s" VARCHAR(20), "t" VARCHAR(20), "n" DOUBLE)')
        run(f"""INSERT INTO "{SCHEMA}"."stats" VALUES ('{SCHEMA}', 'it''s', 41.0)""")
    s = ingest.Settings(url, SCHEMA, "x", estimate_query=f'SELECT "n" FROM "{SCHEMA}"."stats" WHERE "s" = {{schema}} AND "t" = {{table}}')
    assert ingest.estimate(spark, s, "it's") == 41 and ingest.estimate(spark, s, "other") is None


def test_a_load_done_again_doubles_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    assert ingest.add_load(spark.range(10), path, "a") == 10
    assert ingest.add_load(spark.range(5), path, "b") == 5 and spark.read.parquet(path).count() == 15
    assert ingest.add_load(spark.range(7), path, "b") == 7 and spark.read.parquet(path).count() == 17
    assert ingest.add_load(spark.range(0), path, "c") == 0 and spark.read.parquet(path).count() == 17
    assert not [f for f in os.listdir(path) if f.startswith("_load")]


def test_footers_alone_are_read(spark):
    df = catalogue.table_rows(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema: struct<>") == plan.count("FileScan") == len(catalogue.TABLES)
