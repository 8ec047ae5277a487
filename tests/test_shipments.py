"""Graph and feature semantics that the order tables cannot show, on a few hand-made rows."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from freightlens.functions import exprs
from freightlens.operators import features, graph, topn, upsert
from freightlens.sources import shipments as sources
from freightlens.sources.shipments import Shipments, dealt, from_orders, gathered, gathered_lines

MANIFESTS = "mtn string, shipped timestamp_ntz, generator string, generator_name string, generator_state string, facility string, facility_name string, facility_state string, rejection string"
LINES = "mtn string, line_no int, tons double, kg double, hazardous string, usdot_description string, nonhaz_description string, management_code string, management_description string, form_code string, form_description string, source_code string, source_description string, container_code string, container_description string"


def line(mtn, no, tons, kg=None, **more):
    names = [c.split()[0] for c in LINES.split(", ")]
    return tuple({"mtn": mtn, "line_no": no, "tons": tons, "kg": kg, **more}.get(n) for n in names)


def shipments(spark, manifests, lines, carriers=(), imports=(), federal=(), state=()):
    return Shipments(
        spark.createDataFrame(manifests, MANIFESTS),
        spark.createDataFrame(lines, LINES),
        spark.createDataFrame(list(carriers), "mtn string, carrier_line long, transporter string, transporter_name string"),
        spark.createDataFrame([(m,) for m in imports], "mtn string"),
        spark.createDataFrame(list(federal), "mtn string, line_no int, code string"),
        spark.createDataFrame(list(state), "mtn string, line_no int, code string"),
    )


@pytest.fixture(scope="module")
def few(spark):
    at = datetime(2019, 5, 1)
    return shipments(
        spark,
        [("m1", at, "g1", "Gen", "TX", "f1", "Fac", "OK", "Y"), ("m2", at, "g1", "Zen", "AL", None, None, None, "N"), ("m3", at, "g1", "Gen", "TX", "f1", "Fac", "OK", None), ("m4", datetime(2010, 1, 1), "g9", "Old", "TX", "f1", "Fac", "OK", "N")],
        [line("m1", 1, 2.0, 5.0), line("m1", 2, None), line("m3", 1, 1.0)],
        [("m1", 1, "t1", "A"), ("m1", 2, "t1", "B"), ("m1", 3, "t2", "C"), ("m2", 1, "t1", "A"), ("m3", 1, None, None)],
        ["m1", "m1"],
        [("m1", 1, "D001"), ("m1", 1, None)],
        [("m1", 1, "D001"), ("m1", 2, "S2"), ("m3", 1, None)],
    )


def test_year_edges(few):
    (gf,) = graph.year_edges(few, "GF").collect()
    assert (gf.year, gf.generator, gf.facility, gf.manifest_count, gf.total_waste_tons, gf.total_waste_kg) == (2019, "g1", "f1", 2, 3.0, 5.0)
    assert (gf.unique_transporters, gf.unique_waste_codes, gf.rejection_manifest_count, gf.import_manifest_count) == (2, 2, 1, 1)
    gt = {r.transporter: r for r in graph.year_edges(few, "GT").collect()}
    assert {k: (r.manifest_count, r.total_waste_tons, r.unique_facilities) for k, r in gt.items()} == {"t1": (3, 4.0, 1), "t2": (1, 2.0, 1)}
    tf = {r.transporter: r.manifest_count for r in graph.year_edges(few, "TF").collect()}
    assert tf == {"t1": 2, "t2": 1}


def test_nodes(few):
    rows = {(r.node_type, r.business_id): (r.business_name, r.state_code) for r in graph.nodes(few).collect()}
    assert rows == {("GENERATOR", "g1"): ("Zen", "TX"), ("FACILITY", "f1"): ("Fac", "OK"), ("TRANSPORTER", "t1"): ("B", None), ("TRANSPORTER", "t2"): ("C", None)}


def test_blanks_and_keys(spark):
    lines = [line("m1", 1, 1.0, usdot_description="  ", nonhaz_description=" x ", form_code=""), line("m1", 2, 1.0, nonhaz_description="x", form_description="one"), line("m1", 3, 1.0, hazardous="\t")]
    s = shipments(spark, [("m1", datetime(2019, 12, 31, 23), "g", "G", "TX", "f", "F", "TX", "N")], lines)
    staged = graph.stage_lines(s, graph.top_filters(s))
    got = {r.line_no: r for r in staged.collect()}
    assert got[1].nonhaz_description == "x" and got[1].usdot_description is None and got[3].hazardous == "\t"
    assert got[1].waste_stream_key == got[2].waste_stream_key != got[3].waste_stream_key
    assert got[3].primary_description == exprs.UNKNOWN_WASTE and got[1].year_quarter == 201904 and got[1].unique_transporters == 0
    streams = graph.waste_streams(staged).collect()
    assert len(streams) == 2 and {r.display_name for r in streams if r.nonhaz_description} <= {"x | Form: one | Mgmt: Unknown | Source: Unknown | Container: Unknown", "x | Form: Unknown | Mgmt: Unknown | Source: Unknown | Container: Unknown"}


@pytest.mark.parametrize("now, after, want", [(1.0, None, None), (0.0, 1.0, "increase"), (0.0, 0.0, "same"), (0.0, -1.0, "same"), (100.0, 105.0, "increase"), (100.0, 95.0, "decrease"), (100.0, 104.9, "same"), (100.0, 95.1, "same")])
def test_labels(spark, now, after, want):
    df = spark.createDataFrame([(now, after)], "now double, after double")
    assert df.select(exprs.change_label(F.col("now"), F.col("after"))).first()[0] == want


def test_simple_view(spark):
    manifests, lines, codes = [], [], []
    for k, (when, tons) in enumerate([((2018, 2, 1), 1.0), ((2018, 11, 1), 2.0), ((2019, 1, 1), 2.0), ((2019, 1, 2), 0.1)]):
        manifests.append((f"m{k}", datetime(*when), "g", "G", "TX", "f", "F", "TX", "N"))
        lines.append(line(f"m{k}", 1, tons, management_code="B" if k else None))
        codes += [(f"m{k}", 1, "D001"), (f"m{k}", 1, "D002")] if k == 0 else [(f"m{k}", 1, "D001")]
    rows = features.simple_view(shipments(spark, manifests, lines, federal=codes)).orderBy("uid").collect()
    assert [(r.waste_code, r.year_quarter, r.qty_tons, r.qty_tons_lag_1, r.target_class) for r in rows] == [("D001", 20181, 1.0, None, "increase"), ("D001", 20184, 2.0, 1.0, "increase")]
    assert rows[0].std_line_qty_tons is None and rows[0].mode_management_code is None and rows[0].qty_vs_lag_avg_ratio is None
    assert rows[1].qty_vs_lag_avg_ratio == 8.0 and rows[1].uid == 2 and rows[1].quarter_start == date(2018, 10, 1)


def test_ties_at_the_cut(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 5), (None, 9), ("d", None)], "k string, n int")
    assert [r.k for r in topn.top_n(df, "k", F.sum("n"), 2, "s").collect()] == ["c", "a"]
    assert topn.top_n(df, "k", F.sum("n"), 9, "s").collect()[-1].k == "d"
    with pytest.raises(ValueError, match="too long"):
        topn.top_n(df, "k", F.sum("n"), 10**6, "s")


def test_numbers_follow_the_key(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    rows = graph.numbered(df, ["k"], "id", 5).collect()
    assert sorted((r.k, r.id) for r in rows) == [(k, k + 5) for k in range(1000)]
    assert graph.numbered(df.limit(0), ["k"], "id").collect() == []


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "n", "z")], "k int, name string, kept string")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "k int, name string")
    rows = {r.k: (r.name, r.kept) for r in upsert.upsert(old, new, ["k"], ["name"]).collect()}
    assert rows == {1: ("a", "x"), 2: ("B", "y"), 3: ("C", None), None: ("N", "z")}
    assert upsert.duplicate_keys(old.unionByName(old.limit(1)), ["k"]).count() == 1
    assert [r.k for r in upsert.orphans(new, "k", old, "k").collect()] == [3]


def test_quarters():
    assert exprs.quarter_bounds(2018, 4) == (date(2018, 10, 1), date(2019, 1, 1)) and exprs.quarter_bounds(2018, 1) == (date(2018, 1, 1), date(2018, 4, 1))
    with pytest.raises(ValueError):
        exprs.quarter_bounds(2018, 5)


def test_gathered_shipments_are_the_same_and_join_in_place(spark):
    plain, kept = from_orders(spark, "/root/testdata/sf0.001"), gathered(spark, "/root/testdata/sf0.001")
    for name in ("manifests", "lines", "carriers", "imports", "federal_codes", "state_codes"):
        a, b = getattr(plain, name), getattr(kept, name)
        assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())), name
    joined = kept.manifests.join(kept.lines, "mtn").join(kept.carriers, "mtn").hint("merge").groupBy("mtn").count()
    joined.collect()
    assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sent", [0, sources.SENT])
def test_simple_view_writes_no_lines(spark, monkeypatch, sent):
    d, made, write = "/root/testdata/sf0.001", [], features.written
    monkeypatch.setattr(sources, "SENT", sent)
    plain, kept = from_orders(spark, d), gathered_lines(spark, d)
    for name in ("manifests", "lines", "federal_codes"):
        a, b = getattr(plain, name), getattr(kept, name)
        assert set(b.columns) <= set(a.columns) and sorted(map(repr, a.select(b.columns).collect())) == sorted(map(repr, b.collect())), name

    def view(s):
        rows = features.simple_view(s, codes=2, facilities=9, generators=90).collect()
        return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)

    want = view(plain)
    monkeypatch.setattr(features, "written", lambda df: made.append(df.columns) or write(df))
    assert view(kept) == want != []
    assert made and not any("line_no" in columns for columns in made)


def test_dealt_edges_are_the_same_in_parts_by_size(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(sources, "PART", 10_000)
    s = dealt(spark, d)
    assert s.parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    for kind in ("GT", "TF"):
        rows = graph.year_edges(s, kind)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(year") == 1 and plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM")
        want = graph.year_edges(from_orders(spark, d), kind)
        assert sorted(map(repr, rows.collect())) == sorted(map(repr, want.select(rows.columns).collect()))


def test_simple_view_keeps_codes_as_bits_and_writes_its_list_alone(spark, monkeypatch, tmp_path):
    """Line numbers, parts, customers and orders that repeat, unknown parts, missing tons, and more codes than a word has bits."""
    d, src = str(tmp_path), "/root/testdata/sf0.001"
    t = {n: spark.read.parquet(f"{src}/{n}.parquet") for n in ("nation", "customer", "supplier", "part", "orders", "lineitem")}
    again = lambda df, where, **new: df.unionByName(df.filter(where).withColumns({k: F.expr(v) for k, v in new.items()}))
    part = t["part"].filter("p_partkey % 13 > 0").withColumn("p_type", F.concat("p_type", F.col("p_partkey") % 70))
    t["part"] = again(part, "p_partkey % 7 = 0", p_type="if(p_partkey % 2 = 0, null, concat(p_type, 'x'))", p_brand="'Brand#99'")
    t["lineitem"] = again(again(t["lineitem"], "l_orderkey % 3 = 0", l_partkey="l_partkey + 1"), "l_orderkey % 5 = 0").withColumn("l_quantity", F.expr("if(l_suppkey % 4 = 0, null, l_quantity)"))
    t |= {"customer": again(t["customer"], "c_custkey % 9 = 0"), "orders": again(t["orders"], "o_orderkey % 17 = 0")}
    for name, df in t.items():
        df.write.parquet(f"{d}/{name}.parquet")
    plain, kept = from_orders(spark, d), gathered_lines(spark, d)
    rows = lambda df: sorted(map(repr, df.groupBy("facility", "waste_code", "generator").agg(F.sum("_tons")).collect()))
    want = rows(features.base_lines(plain).groupingSets([["facility", "waste_code"], ["generator"]], "facility", "waste_code", "generator").agg(F.sum("tons").alias("_tons")))
    assert t["part"].select("p_type").distinct().count() > 64 and rows(features._sums(kept)) == want != []
    written = []
    write = sources.written
    monkeypatch.setattr(sources, "written", lambda df: written.append(write(df)) or written[-1])
    view = lambda s: sorted(map(repr, features.simple_view(s, codes=20, facilities=9, generators=5).drop("avg_line_qty_tons", "std_line_qty_tons").collect()))
    assert view(kept) == view(plain) != []
    orders = next(df for df in written if "o_orderkey" in df.columns)
    assert orders.select("o_custkey").distinct().count() == 5
    monkeypatch.setattr(sources, "MOST_CODES", 3)
    assert kept.amounts() is None and rows(features._sums(kept)) == want
