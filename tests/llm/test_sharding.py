"""The lookup table and placements."""

from collections import Counter

import pytest

from freightlens.llm import sharding


def slow_fill(shards, size):
    prefer = []
    for s in shards:
        first, step = sharding._number(f"{s}:offset") % size, sharding._number(f"{s}:skip") % (size - 1) + 1
        prefer.append([(first + j * step) % size for j in range(size)])
    owner = {}
    while len(owner) < size:
        for k, p in enumerate(prefer):
            if len(owner) < size:
                owner[next(x for x in p if x not in owner)] = k
    return [owner[i] for i in range(size)]


def test_fill_by_turns():
    for n, size in ((1, 7), (3, 31), (10, 101)):
        names = [f"s{i}" for i in range(n)]
        table = sharding.fill(names, size)
        assert table == slow_fill(names, size)
        count = Counter(table).values()
        assert max(count) - min(count) <= 1


def test_few_moves_when_a_shard_goes():
    names = list(sharding.SHARDS)
    a, b = sharding.fill(names), sharding.fill(names[:-1])
    kept = [x for x, y in zip(a, b) if x != len(names) - 1 and x == y]
    assert len(kept) > 0.85 * sum(x != len(names) - 1 for x in a)


def test_bad_tables():
    for shards, size in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.fill(shards, size)


def test_placement(spark):
    rows = [(i, "x") for i in range(5000)] + [(None, "x"), (None, "y"), (3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, shard string")
    out = sharding.place(df).collect()
    table = sharding.fill(sharding.SHARDS)
    assert len(out) == len(rows)
    for r in out:
        slot = sharding._number(f"place:{'' if r.doc_id is None else r.doc_id}") % sharding.TABLE_SIZE
        assert (r.slot, r.shard) == (slot, sharding.SHARDS[table[slot]])
    assert sharding.place(df.limit(0)).collect() == []
    assert max(Counter(r.shard for r in out).values()) < 2 * len(rows) / 32
