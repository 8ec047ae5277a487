"""Links, counts and components against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightlens.llm import neardup


def brute(rows, threshold=0.9):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v in rows]
    unit = [np.array(v, float) / np.abs(np.array(v, float)).max() if k else None for (_, v), k in zip(rows, ok)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    links = {i: {j for j in range(len(rows)) if i != j and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold} for i in range(len(rows))}
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), least, rows[i][0] == least))
    return sorted(out, key=str)


def vectors(n=400, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    for a in range(0, n // 2, 20):
        x[a : a + 20] = x[a] + rng.normal(size=(20, dim)) * rng.choice([0.1, 0.3, 0.45])
    x[-30:] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return rows + [(9000, None), (9001, []), (9002, [0.0] * dim), (9003, [None] * dim), (9004, [float("nan")] * dim), (9005, [float("inf")] + [0.0] * (dim - 1)), (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (None, x[7].tolist()), (None, None), (7, x[7].tolist()), (9008, (x[50] * 1e-30).tolist())]


@pytest.mark.parametrize("per_cell,block,reach", [(1000, 2048, 0.25), (40, 16, 1.0)])
def test_equals_all_pairs(spark, monkeypatch, per_cell, block, reach):
    monkeypatch.setattr(neardup, "PER_CELL", per_cell)
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "PROBES", 64)
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, own string").selectExpr("*", "own as h", "own as v", "own as cell", "own as n_links").repartition(5)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup.dedup(df, reach=reach).collect()), key=str)
    want = [(a, b, c, a == c if a is not None or c is not None else True) for a, b, c, _ in brute(rows)]
    assert got == sorted(want, key=str)


def test_lengths_that_are_common_have_cells_of_their_own(spark, monkeypatch):
    """Three lengths of more than a block each and many rare ones: all links, and no cell that holds most of a length."""
    monkeypatch.setattr(neardup, "PER_CELL", 40)
    monkeypatch.setattr(neardup, "BLOCK", 100)
    rows = []
    for k, dim in enumerate((16, 17, 24)):
        rows += [(10_000 * k + i, v) for i, v in vectors(300 - 40 * k, dim, seed=k) if i is not None and i < 9000]
    rows += [(50_000 + d, [float(x + 1) for x in range(d)]) for d in range(1, 60)] + [(60_000 + d, [float(x + 1) for x in range(d)]) for d in range(1, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = sorted(tuple(r) for r in neardup.dedup(df, reach=1.0).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == sorted(brute(rows))
    keyed = df.select(F.xxhash64("embedding").alias("h"), F.col("embedding").alias("v"), F.lit(1).cast("bigint").alias("copies")).dropDuplicates(["h"])
    cells, most = neardup._indexed(keyed, 0.9, 1.0, 11)
    held = cells.groupBy(F.size("v").alias("d"), "own").count().collect()
    assert len({r.own for r in held}) == len(held) <= most
    for dim in (16, 17, 24):
        sizes = [r["count"] for r in held if r.d == dim]
        assert len(sizes) >= 3 and max(sizes) < 0.8 * sum(sizes)
    assert keyed.count() == cells.count()


@pytest.mark.parametrize("sent", [0, 1024**2])
def test_sizes_of_many_cells_are_joined_by_a_shuffle(spark, monkeypatch, sent):
    monkeypatch.setattr(neardup, "MAX_SENT", sent)
    monkeypatch.setattr(neardup, "PER_CELL", 40)
    rows = [r for r in vectors(200) if r[0] is not None]
    got = sorted((tuple(r) for r in neardup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), reach=1.0).collect()), key=str)
    assert got == brute(rows)


def planted(n, dim, seed, groups=400):
    """n vectors around 12 themes; `groups` of them have near copies at cosines from 0.88 up."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) + 1.5 * rng.normal(size=(12, dim))[rng.integers(0, 12, n)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = groups
    for g in range(groups):
        for _ in range(rng.integers(1, 8)):
            away = rng.normal(size=dim)
            away -= (away @ x[g]) * x[g]
            cos = rng.uniform(0.88, 0.99)
            x[at % n] = cos * x[g] + np.sqrt(1 - cos**2) * away / np.linalg.norm(away)
            at += 1
    return rng.permutation(x).astype(np.float32)


@pytest.mark.parametrize("per_cell,centres,dim", [(100, 1024, 64), (100, 8, 64), (100, 1024, 8)])
def test_recall_with_narrow_borders(spark, monkeypatch, per_cell, centres, dim):
    """Many cells, of one set of centres and of two: 0.9 of all links at least, and none that is not there."""
    monkeypatch.setattr(neardup, "PER_CELL", per_cell)
    monkeypatch.setattr(neardup, "MAX_CENTRES", centres)
    x = planted(4000, dim, 8)
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    rows = neardup.dedup(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    got = np.zeros(len(x), int)
    got[[r.vec_id for r in rows]] = [r.n_links for r in rows]
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum() > 1000
    print(f"recall {got.sum() / want.sum():.4f} in {dim} dimensions, cells of {per_cell}, {centres} centres")


def test_cells_on_small_tables(spark):
    """k-means divides tables of any size from two vectors on."""
    from freightlens.llm.common import load

    rows = load(spark, "/root/testdata/sf0.01", "embeddings").select(F.xxhash64("embedding").alias("h"), F.col("embedding").alias("v"), F.lit(1).cast("bigint").alias("copies"))
    for df in (rows, rows.limit(2)):
        n = df.count()
        cells, most = neardup._indexed(df, 0.9, 0.2, 11)
        assert most >= cells.select("own").distinct().count() >= 2 and cells.count() == n


def test_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert neardup.dedup(empty).collect() == []
    one = neardup.dedup(spark.createDataFrame([(5, [0.0])], "vec_id long, embedding array<double>")).collect()
    assert [tuple(r) for r in one] == [(5, 0, 5, True)]
