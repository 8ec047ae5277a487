"""Mixing: shares, caps, nearness to targets, and odd rows."""

from collections import defaultdict

from freightlens.llm import mixing


def mix(spark, rows, columns="doc_id long, text string, source string", **kw):
    df = mixing.mix(spark.createDataFrame(rows, columns), **kw)
    return [r.asDict() for r in df.collect()]


def shares(sizes, cap=3, weights=(5, 2, 1)):
    """Targets by raising one level until nothing is above its cap."""
    order = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    w = {k: weights[i % 3] for i, k in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = total - sum(fixed.values())
        open_ = [k for k in order if k not in fixed]
        out = fixed | {k: left * w[k] / sum(w[x] for x in open_) for k in open_}
        over = [k for k in open_ if out[k] > cap * sizes[k]]
        if not over:
            return out
        fixed |= {k: cap * sizes[k] for k in over}


def test_targets_and_takings(spark):
    rows, n = [], 0
    for s, docs in (("b", 300), ("a", 20), (None, 40), ("é", 5), ("Z", 120)):
        for i in range(docs):
            n += 1
            rows.append((n, "word " * (1 + (i * 37) % 150), s))
    out = mix(spark, rows)
    sizes, taken, most, target = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for r in out:
        s = r["source"]
        assert r["_size"] == len(r["text"].split()) and 0 <= r["_copies"] <= 3
        sizes[s] += r["_size"]
        taken[s] += r["_copies"] * r["_size"]
        most[s] = max(most[s], r["_size"])
        target[s] = r["target"]
    want = shares(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * want[s]
        assert abs(taken[s] - target[s]) <= most[s] / 2
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(7)).collect()
    assert {r.doc_id: r._copies for r in again} == {r["doc_id"]: r["_copies"] for r in out}


def test_longer_documents_are_likelier(spark):
    rows = [(i, "w " * (100 if i % 2 else 10), s) for i in range(2000) for s in ("a", "b", "c")]
    out = mix(spark, rows)
    mean = lambda s, size: sum(r["_copies"] for r in out if r["source"] == s and r["_size"] == size) / 1000
    for s in "bc":
        assert abs(mean(s, 10) / mean(s, 100) - 0.5) < 0.12


def test_odd_rows(spark):
    columns = "doc_id long, text string, source string, target string, _size int"
    assert mix(spark, [], columns) == []
    rows = [(1, None, "a", "x", 1), (2, "", None, "x", 1), (3, " \t", "b", "x", 1)]
    assert [(r["_size"], r["_copies"], r["target"]) for r in mix(spark, rows, columns)] == [(0, 0, 0.0)] * 3
    rows = [(None, "one two", "a", "x", 1)] * 5 + [(7, "one\x0btwo three", "a", "x", 1)] * 2 + [(8, "x " * 50_000, None, "x", 1)]
    out = mix(spark, rows, columns)
    assert len(out) == 8 and sorted({r["_size"] for r in out}) == [2, 50_000]
    assert all(r["_copies"] <= 3 for r in out)
    assert "x" not in {r["target"] for r in out}


def test_equal_rows_and_missing_ids_are_drawn_apart(spark):
    """Sources of null ids, of one id and of one and the same row come near their targets like others."""
    rows = [(None, f"w{i} " * (1 + i % 90), "a") for i in range(400)] + [(7, f"w{i} " * (1 + i % 90), "b") for i in range(400)]
    rows += [(9, "same words here", "c")] * 3000 + [(i, "x " * 40, "d") for i in range(1000, 1700)] + [(None, "y", "e")]
    out = mix(spark, rows)
    assert len(out) == len(rows) and all(0 <= r["_copies"] <= 3 for r in out)
    for s, room in (("a", 45), ("b", 45), ("c", 3), ("d", 20), ("e", 1)):
        mine = [r for r in out if r["source"] == s]
        assert abs(sum(r["_copies"] * r["_size"] for r in mine) - mine[0]["target"]) <= room, s
    assert len({r["_copies"] for r in out if r["source"] == "c"}) == 2
    assert sorted((str(r["doc_id"]), r["text"], r["_copies"]) for r in mix(spark, rows)) == sorted((str(r["doc_id"]), r["text"], r["_copies"]) for r in out)


def test_many_sources(spark):
    """A source for each document: shares by the same rule, numbered over several ranges."""
    rows = [(i, "w " * (1 + i * 7919 % 97), f"http://{i * 31 % 5003}") for i in range(3000)]
    out = mix(spark, rows)
    want = shares({r["source"]: r["_size"] for r in out})
    assert all(abs(r["target"] - want[r["source"]]) <= 1e-9 * want[r["source"]] for r in out)


def test_user_columns_survive(spark):
    df = spark.createDataFrame([(1, "a b", "s", 5, 6)], "doc_id long, text string, source string, _id int, _odds int")
    row = mixing.mix(df).first()
    assert (row["_id"], row["_odds"], row["_size"]) == (5, 6, 2)


def test_equal_rows_under_any_partitioning(spark):
    """The same rows are taken whatever partitions they come in, and as near to the target as one row allows."""
    equal = spark.createDataFrame([(7, "some words " * 30, "a")] * 4000 + [(i, f"other {i}", "b") for i in range(500)], "doc_id long, text string, source string")
    trebled = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    trebled = trebled.unionByName(trebled).unionByName(trebled)
    for docs in (equal, trebled):
        found = []
        for n in (1, 3, 7):
            rows = mixing.mix(docs.repartition(n)).select("doc_id", "source", "_size", "target", "_copies").collect()
            found.append(sorted(((str(r.doc_id), str(r.source), r._copies) for r in rows)))
            for s in {r.source for r in rows}:
                mine = [r for r in rows if r.source == s]
                # Equal rows of the trebled table: one of them more or less.
                assert abs(sum(r._copies * r._size for r in mine) - mine[0].target) <= max(r._size for r in mine)
        assert found[0] == found[1] == found[2]
