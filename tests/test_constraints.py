"""Keys and references: planted faults, nulls, one scan a table, and the record of a build."""

import pytest

from freightlens.operators.constraints import Key, Reference, _entries, check, graph_constraints, run_constraints
from freightlens.plans import catalogue
from freightlens.streaming import quarters


def faults(tables, constraints):
    return {r.constraint: (r.kind, r.rows, r.bad) for r in check(tables, constraints).collect()}


def test_planted_faults(spark):
    nodes = spark.createDataFrame([(1, "A", "x"), (2, "B", "x"), (2, "A", "y"), (None, "A", "y"), (5, "A", None), (6, "A", None)], "id long, kind string, name string")
    edges = spark.createDataFrame([("x", 1), ("y", 1), ("z", 1), ("z", 2), (None, 3)], "a string, n int")
    constraints = [
        Key("pk", "nodes", ("id",), True), Key("uq", "nodes", ("kind", "name")), Key("free", "edges", ("n",)),
        Reference("fk", "edges", (("A",), "a"), "nodes", ("kind", "name")), Reference("wrong", "edges", (("B",), "a"), "nodes", ("kind", "name")), Reference("self", "nodes", ("name",), "nodes", ("name",)),
    ]
    assert faults({"nodes": nodes, "edges": edges}, constraints) == {
        "pk": ("primary", 6, 2), "uq": ("unique", 6, 1), "free": ("unique", 5, 2), "fk": ("reference", 5, 2), "wrong": ("reference", 5, 3), "self": ("reference", 6, 0),
    }
    empty = {"nodes": nodes.limit(0), "edges": edges.limit(0)}
    assert {v[1:] for v in faults(empty, constraints).values()} == {(0, 0)}
    with pytest.raises(ValueError, match="no table named edges"):
        check({"nodes": nodes}, constraints)


def test_values_are_not_glued(spark):
    rows = spark.createDataFrame([("a,b", "c"), ("a", "b,c"), ("a", "b"), ("ab", "")], "x string, y string")
    assert faults({"t": rows}, [Key("k", "t", ("x", "y"))])["k"][2] == 0


def test_one_scan_a_table(spark, tmp_path):
    tables = {}
    for name in ("nodes", "streams", *[f"{t}_{k}" for t in ("years", "quarters") for k in ("gf", "gt", "tf")], *[f"top_{c}" for c in ("line_no", "facility", "generator", "transporter")]):
        columns = sorted({p for c in graph_constraints() for t, parts in ((c.table, c.columns), (getattr(c, "parent", None), getattr(c, "parent_columns", ()))) if t == name for p in parts if isinstance(p, str)})
        spark.createDataFrame([tuple("v" for _ in columns)], ", ".join(f"{c} string" for c in columns)).write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
    out = check(tables, graph_constraints())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == len(tables)
    assert {r.bad for r in out.filter("kind <> 'reference'").collect()} == {0}


def test_record_of_a_build(spark, tmp_path):
    root = str(tmp_path / "g")
    for mode in ("load", "all"):
        quarters.tracked_run(spark, root, mode, lambda run: quarters.mark(spark, root, [201801, 201802], "stage", "SUCCESS", run))
    tables = {"runs": quarters.runs(spark, root), "states": quarters.states(spark, root), "steps": quarters.steps(spark, root)}
    assert {(r.rows, r.bad) for r in check(tables, run_constraints()).collect()} == {(2, 0), (4, 0)}
    quarters.mark(spark, root, [201803], "stage", "SUCCESS", "unknown")
    assert faults(tables | {"steps": quarters.steps(spark, root)}, run_constraints())["graph_build_step_run_id_fkey"] == ("reference", 5, 1)


def test_the_graph_has_no_faults(spark):
    rows = catalogue.QUERIES["constraint_checks"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(graph_constraints()) and all(r.bad == 0 < r.rows for r in rows)


def test_a_key_of_all_columns_sends_no_values(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "z")], "n int, a string")
    plain, primary, reference = Key("k", "t", ("n", "a")), Key("p", "t", ("n", "a"), True), Reference("r", "t", ("a",), "u", ("a",))
    assert _entries("t", rows, [plain]).filter("v is not null").count() == 0
    parents = spark.createDataFrame([("x",)], "a string")
    assert faults({"t": rows, "u": parents}, [plain, primary, reference]) == {"k": ("unique", 4, 1), "p": ("primary", 4, 2), "r": ("reference", 4, 2)}
