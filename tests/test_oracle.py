"""Every query against its SQL, row for row, on the small order tables."""

import datetime
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from freightlens.plans import catalogue

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def _plain(v):
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)[:10]
    if isinstance(v, (list, np.ndarray)):
        return tuple(map(_plain, v))
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def check(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    a, b = rows_of(df.columns, df.collect()), rows_of(want.columns, want.fetchall())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert a[1] == b[1]
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double"}
    got = dict(df.dtypes)
    for c, t in zip(want.columns, want.types):
        if str(t) in kinds:
            assert got[c] == kinds[str(t)], (c, got[c], str(t))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    check(spark, name)


#: Without SQL: figures by class of trained models, and losses by epoch (tests/test_training.py has the numpy versions).
PLAIN = sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES))


@pytest.mark.parametrize("name", [n for n in PLAIN if n != "training_losses"])
def test_models_report_every_class(spark, name):
    rows = catalogue.QUERIES[name](spark, SF).collect()
    assert {r.label for r in rows} <= {0, 1, 2} and rows and all(0 <= r.f1 <= 1 for r in rows)


def test_losses_fall(spark):
    rows = catalogue.QUERIES["training_losses"](spark, "/root/testdata/sf0.001").collect()
    for kind in ("sgd", "network"):
        losses = [r.loss for r in sorted(rows, key=lambda r: r.epoch) if r.kind == kind]
        assert len(losses) == 5 and losses[-1] < losses[0]


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
