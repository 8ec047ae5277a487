"""Splits, one-hot columns, null policy, kept models; type names, settings and sinks of the ingest."""

from decimal import Decimal
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freightlens.operators import ml
from freightlens.sources import ingest, tables

F_DECIMAL = Decimal("830.00")


def test_split_and_pages(spark):
    df = spark.range(1, 1001).withColumnRenamed("id", "uid")
    parts = {p: ml.split(df, p).count() for p in ml.SPLITS}
    assert parts == {"train": 700, "validation": 150, "test": 150}
    assert ml.pages_of(1000, 100) == {"train": 7, "validation": 2, "test": 2}
    assert [r.uid for r in ml.page(df, 10, 2).collect()] == list(range(21, 31))


def test_one_hot_of_unknown_levels(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z"), (4, None)], "uid int, c string")
    rows = {r.uid: (r.c_b, r.c_d) for r in ml.one_hot(df, "c", ["a", "b", "d"]).collect()}
    assert rows == {1: (0, 0), 2: (1, 0), 3: (0, 0), 4: (0, 0)}
    assert ml.levels(df, "c") == ["a", "b", "z"] and ml.one_hot(df, "c", ["a"]).columns == ["uid"]


def test_null_policy(spark):
    df = spark.createDataFrame([(1, "increase", 5.0, 1.0, None, "x"), (2, "same", 5.0, None, 2, "y"), (3, "decrease", 5.0, 2.0, 3, None), (4, "same", 5.0, 2.0, 3, "y")], "uid long, target_class string, next_qty_tons double, qty_tons_lag_1 double, n int, cat string")
    rows = {r.uid: r for r in ml.transform_graph(df, {"cat": ["x", "y"]}).collect()}
    assert set(rows) == {1, 3, 4} and rows[1].n == 0 and rows[3].cat_y == 0 and (rows[1].label, rows[3].label) == (2, 0)
    assert "next_qty_tons" not in rows[1].asDict() and "next_qty_tons" in ml.transform_graph(df, {"cat": ["x", "y"]}, keep_next=True).columns
    assert [r.uid for r in ml.transform_simple(df, {"cat": ["x", "y"]}).collect()] == [4]


def test_models_are_kept(spark, tmp_path):
    train = spark.range(90).select(F.col("id").alias("uid"), (F.col("id") % 3).cast("int").alias("label"), (F.col("id") % 3 - 1).cast("double").alias("x"))
    path = str(tmp_path / "m")
    model = ml.fit_or_load(path, ml.clamp(train, ["x"]), "bayes")
    loaded = ml.fit_or_load(path, train.limit(0), "bayes")
    a, b = ([r.prediction for r in m.transform(ml.clamp(train, ["x"])).orderBy("uid").collect()] for m in (model, loaded))
    assert a == b
    ml.dump(train, str(tmp_path / "d"))
    assert spark.read.csv(str(tmp_path / "d" / "x")).count() == spark.read.csv(str(tmp_path / "d" / "y")).count() == 90


def test_type_names():
    assert ingest.map_type("BIGINT") == T.LongType() and ingest.map_type("money") == T.DecimalType(38, 18) and ingest.map_type("decimal", 10, 2) == T.DecimalType(10, 2)
    assert {ingest.map_type(t) for t in ("varchar", "xml", "uniqueidentifier", "time", "anything")} == {T.StringType()}
    row = {"COLUMN_NAME": "a", "DATA_TYPE": "tinyint", "NUMERIC_PRECISION": 3, "NUMERIC_SCALE": 0, "IS_NULLABLE": "NO"}
    assert ingest.struct_of([row]) == T.StructType([T.StructField("a", T.ShortType(), False)])


def test_settings(tmp_path):
    with pytest.raises(ValueError, match="url, target"):
        ingest.Settings.of({"schema": "s"})
    s = ingest.Settings.of({"url": "jdbc:x", "schema": "s", "target": "t", "fetch_size": 10, "other": 1})
    assert s.fetch_size == 10 and s.truncate_before_load


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, bytearray(b"\xff\x00")), (2, "x,y", None)], "a int, b string, c binary")
    ingest.land_csv(df, str(tmp_path / "c"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("*.csv")))
    assert "1,\\N,\\xff00" in text.replace("\\\\", "\\").replace('"', "") and '"x,y"' in text
    for _ in range(2):
        ingest.land(df, str(tmp_path / "p"))
    ingest.land(df, str(tmp_path / "p"), truncate=False)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
    assert ingest.materialized(df, str(tmp_path / "v"), "seen").count() == spark.table("seen").count() == 2


URL = "jdbc:derby:memory:source"


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    """A database in this process with the catalog views that the ingest asks for."""
    url, folder = f"{URL};create=true", tmp_path_factory.mktemp("derby")
    spark._jvm.System.setProperty("derby.system.home", str(folder))
    spark._jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    run = connection.createStatement().execute
    for sql in (
        'CREATE SCHEMA "dbo"', 'CREATE TABLE "dbo"."Line Items" ("id" INT NOT NULL, "o\'clock" VARCHAR(20), "tons" DECIMAL(10, 2), "raw" VARCHAR(4) FOR BIT DATA)', 'CREATE TABLE "dbo"."empty" ("id" BIGINT NOT NULL)', 'CREATE TABLE "dbo"."notes" ("t" VARCHAR(10))',
        "CREATE SCHEMA INFORMATION_SCHEMA", "CREATE TABLE INFORMATION_SCHEMA.TABLES (TABLE_NAME VARCHAR(40), TABLE_TYPE VARCHAR(20), TABLE_SCHEMA VARCHAR(20))",
        "CREATE TABLE INFORMATION_SCHEMA.COLUMNS (TABLE_SCHEMA VARCHAR(20), TABLE_NAME VARCHAR(40), COLUMN_NAME VARCHAR(40), DATA_TYPE VARCHAR(20), CHARACTER_MAXIMUM_LENGTH INT, NUMERIC_PRECISION INT, NUMERIC_SCALE INT, IS_NULLABLE VARCHAR(3), ORDINAL_POSITION INT)",
        *[f"INSERT INTO INFORMATION_SCHEMA.TABLES VALUES ('{t}', '{k}', 'dbo')" for t, k in (("notes", "BASE TABLE"), ("Line Items", "BASE TABLE"), ("empty", "BASE TABLE"), ("a view", "VIEW"), ("gone", "BASE TABLE"))],
        *[f"INSERT INTO INFORMATION_SCHEMA.COLUMNS VALUES ('dbo', '{t}', '{c}', '{k}', {n}, {p}, {q}, '{nul}', {i})" for t, c, k, n, p, q, nul, i in (
            ("Line Items", "tons", "decimal", "NULL", 10, 2, "YES", 3), ("Line Items", "id", "int", "NULL", 10, 0, "NO", 1), ("Line Items", "o\'\'clock", "varchar", 20, "NULL", "NULL", "YES", 2), ("Line Items", "raw", "varbinary", 4, "NULL", "NULL", "YES", 4),
            ("empty", "id", "bigint", "NULL", 19, 0, "NO", 1), ("notes", "t", "nvarchar", 10, "NULL", "NULL", "YES", 1), ("gone", "t", "int", "NULL", 10, 0, "YES", 1),
        )],
        *[f"""INSERT INTO "dbo"."Line Items" VALUES ({i}, 'row {i}', {i}.25, X'00ff')""" for i in range(1, 41)], """INSERT INTO "dbo"."Line Items" VALUES (41, NULL, NULL, NULL)""", """INSERT INTO "dbo"."notes" VALUES ('x')""",
    ):
        run(sql)
    connection.close()
    return URL


def test_ingest_of_a_whole_schema(spark, database, tmp_path):
    (tmp_path / "s.yaml").write_text(f"url: '{database}'\nschema: dbo\ntarget: {tmp_path}/landed\nfetch_size: 7\n")
    s = ingest.Settings.read(str(tmp_path / "s.yaml"))
    for _ in range(2):  # truncated before the second load
        rows = {r.table: r for r in ingest.run(spark, s, pause=0.01).collect()}
    assert {t: (r.rows, r.status, r.estimate) for t, r in rows.items()} == {"Line Items": (41, "SUCCESS", None), "empty": (0, "SUCCESS", None), "gone": (None, "FAILED", None), "notes": (1, "SUCCESS", None)}
    assert "gone" in rows["gone"].error
    landed = spark.read.parquet(f"{tmp_path}/landed/Line Items")
    assert landed.dtypes == [("id", "int"), ("o'clock", "string"), ("tons", "decimal(10,2)"), ("raw", "binary")]
    assert landed.agg(F.sum("id"), F.sum("tons"), F.count("raw")).first()[:] == (861, F_DECIMAL, 40)
    assert ingest.bounds_of(spark, s, "Line Items", "id") == (1, 42) and ingest.bounds_of(spark, s, "empty", "id") is None
    parts = ingest.table_reader(spark, s, "Line Items", "id", (1, 42), 4).load()
    assert parts.rdd.getNumPartitions() == 4 and parts.count() == 41


def test_names_are_quoted(spark):
    s = ingest.Settings("jdbc:x", "d'bo", "t")
    assert "TABLE_SCHEMA = 'd''bo'" in ingest.tables_query(s.schema) and "TABLE_NAME = 'a''b'" in ingest.columns_query(s.schema, "a'b") and "o.name = 'a''b'" in ingest.count_query(s.schema, "a'b")
    assert ingest.name("a", 'b"c') == '"a"."b""c"'


def test_attempts():
    from pyspark.errors import PySparkException

    calls = []

    def twice_broken():
        calls.append(1)
        if len(calls) < 3:
            raise PySparkException("not yet")
        return "done"

    assert ingest.attempts(twice_broken, pause=0.0) == "done" and len(calls) == 3
    with pytest.raises(PySparkException):
        ingest.attempts(lambda: (_ for _ in ()).throw(PySparkException("never")), tries=2, pause=0.0)


def test_tables_are_made_once(spark):
    tables.ensure_table(spark, "made.nodes", "node_type string, business_id string", bucket_by=["business_id"], buckets=4)
    spark.createDataFrame([("A", "1")], "node_type string, business_id string").write.format("parquet").bucketBy(4, "business_id").sortBy("business_id").mode("append").saveAsTable("made.nodes")
    tables.ensure_table(spark, "made.nodes", "node_type string, business_id string", bucket_by=["business_id"], buckets=4)
    assert spark.table("made.nodes").count() == 1
    assert "Exchange" not in spark.table("made.nodes").groupBy("business_id").count()._jdf.queryExecution().executedPlan().toString()
    tables.ensure_table(spark, "made.edges", "year int, tons double", partition_by=["year"])
    assert spark.table("made.edges").columns == ["tons", "year"]


def test_a_cluster_needs_a_shared_folder():
    session = lambda master, root=None: SimpleNamespace(conf=SimpleNamespace(get=lambda *a: root), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(session("spark://host:7077"))
    assert tables.shared_folder(session("spark://host:7077", "s3://bucket/x/")) == "s3://bucket/x"


def test_classes_that_only_are_predicted(spark):
    matrix = spark.createDataFrame([(0, 0, 5), (0, 2, 5)], "label int, prediction int, n bigint")
    rows = {r.label: (r.support, r.precision, r.recall, r.f1) for r in ml.class_metrics(matrix).collect()}
    assert rows == {0: (10, 1.0, 0.5, 2 / 3), 2: (0, 0.0, 0.0, 0.0)}
    assert ml.overall(matrix).first()[:] == (0.5, 0.5)


def test_levels_are_bounded(spark):
    df = spark.range(5).selectExpr("cast(id as string) as c")
    assert ml.domains(df, ["c"]) == {"c": ["0", "1", "2", "3", "4"]}
    with pytest.raises(ValueError, match="category"):
        ml.levels(df, "c", most=4)


def test_logistic_model_equals_a_plain_fit(spark):
    """One class against the others, each fitted by Newton's method in numpy."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (x @ rng.normal(size=(3, 3)) + rng.gumbel(size=(400, 3))).argmax(axis=1)
    df = spark.createDataFrame([(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y))], "uid long, a double, b double, c double, label int")
    ones, scores = np.hstack([x, np.ones((400, 1))]), []
    for k in range(3):
        w = np.zeros(4)
        for _ in range(30):
            p = 1 / (1 + np.exp(-ones @ w))
            w += np.linalg.solve((ones * (p * (1 - p))[:, None]).T @ ones, ones.T @ ((y == k) - p))
        scores.append(ones @ w)
    got = np.array([r.prediction for r in ml.fit(df, "logistic").transform(df).orderBy("uid").collect()])
    assert (got == np.argmax(scores, axis=0)).mean() > 0.98


def test_categories_of_all_lines_are_found_by_one_pass(spark, monkeypatch):
    from freightlens.plans import catalogue
    from freightlens.sources.shipments import from_orders, gathered_lines

    d, read, levels = "/root/testdata/sf0.001", [], ml.levels
    want = catalogue._domains(from_orders(spark, d))
    monkeypatch.setattr(ml, "levels", lambda df, *a: read.extend(df.inputFiles()) or levels(df, *a))
    assert catalogue._domains(gathered_lines(spark, d)) == want and all(want.values())
    assert read and not any("lineitem" in f for f in read)
