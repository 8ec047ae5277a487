"""Sparse features against columns, and categories that are too large for columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightlens.operators import ml, sparse


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(1, 301).withColumnRenamed("id", "uid")
    c, d = F.concat(F.lit("a"), F.col("uid") * 7 % 11), F.when(F.col("uid") % 5 > 0, F.concat(F.lit("b"), F.col("uid") % 4))
    return df.select("uid", (F.col("uid") % 3).cast("int").alias("label"), (F.col("uid") % 7).alias("n"), c.alias("c"), d.alias("d"))


def test_levels_and_entries(spark, rows):
    table = sparse.levels({"c": (rows.filter("c <> 'a5'"), "c"), "d": (rows, "d"), "e": (rows, "label")})
    found = {}
    for r in table.orderBy("category", "position").collect():
        found.setdefault(r.category, []).append((r.position, r.level))
    assert found == {"c": list(enumerate(sorted(f"a{i}" for i in range(11) if i != 5))), "d": list(enumerate(["b0", "b1", "b2", "b3"])), "e": list(enumerate("012"))}
    n = sparse.sizes(table)
    assert n == {"c": 10, "d": 4, "e": 3}
    got = {}
    for r in sparse.entries(sparse.with_places(rows, table, ["c", "d"]), ["c", "d"], n).collect():
        got.setdefault(r.uid, {})[r["index"]] = r.value
    c, d = ([level for _, level in found[k]] for k in "cd")
    for r in rows.collect():
        want = {0: float(r.n)} if r.n else {}
        if r.c in c[1:]:
            want[c.index(r.c)] = 1.0
        if r.d in d[1:]:
            want[9 + d.index(r.d)] = 1.0
        assert got.get(r.uid, {}) == want


@pytest.mark.parametrize("kind", ["bayes", "logistic"])
def test_same_predictions_as_columns(rows, kind):
    table = sparse.levels({"c": (rows, "c"), "d": (rows, "d")})
    domains = ml.domains(rows, ["c", "d"])
    columns = rows
    for c, values in domains.items():
        columns = ml.one_hot(columns, c, values)
    dense = ml.fit(columns, kind).transform(columns)
    placed = sparse.features(sparse.with_places(rows, table, ["c", "d"]), ["c", "d"], sparse.sizes(table))
    few = sparse.fit(placed, kind).transform(placed)
    as_dict = lambda df: {r.uid: r.prediction for r in df.select("uid", "prediction").collect()}
    assert as_dict(few) == as_dict(dense)
    # Vectors hold what entries say.
    want = {(r.uid, r["index"]): r.value for r in sparse.entries(sparse.with_places(rows, table, ["c", "d"]), ["c", "d"], sparse.sizes(table)).collect()}
    assert {(r.uid, int(i)): float(r.features[int(i)]) for r in placed.collect() for i in range(r.features.size) if r.features[int(i)]} == want


def test_many_levels(spark):
    rows = spark.range(1, 40_001).select(F.col("id").alias("uid"), (F.col("id") % 3).cast("int").alias("label"), (F.col("id") % 20_000).cast("string").alias("c"))
    with pytest.raises(ValueError):
        ml.levels(rows, "c")
    table = sparse.levels({"c": (rows, "c")})
    n = sparse.sizes(table)
    assert n == {"c": 20_000}
    placed = sparse.features(sparse.with_places(rows, table, ["c"]), ["c"], n)
    assert placed.first().features.size == 19_999
    model = sparse.fit(placed, "bayes")
    ids = np.arange(1, 40_001)
    counts = np.zeros((3, 20_000))
    np.add.at(counts, (ids % 3, ids % 20_000), 1)
    counts = counts[:, sorted(range(20_000), key=str)][:, 1:] + 1
    prior = np.log(np.bincount(ids % 3) + 1) - np.log(40_000 + 3)
    theta = np.log(counts / counts.sum(axis=1, keepdims=True)) + prior[:, None]
    best = dict(zip(sorted(map(str, range(20_000)))[1:], theta.argmax(axis=0))) | {"0": prior.argmax()}
    got = model.transform(placed.join(rows.select("uid", "c"), "uid")).select("c", "prediction").collect()
    assert len(got) == 40_000 and all(r.prediction == best[r.c] for r in got)


def test_no_levels(rows):
    some = rows.drop("d")
    table = sparse.levels({"c": (some.limit(0), "c")})
    placed = sparse.features(sparse.with_places(some, table, ["c"]), ["c"], sparse.sizes(table))
    assert placed.count() == 300 and placed.first().features.size == 1
