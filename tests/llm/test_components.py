"""Components against plain Python, and the tables written on the way to them."""

import random

import pytest

from freightlens.llm import components


def expected(links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return sorted((x, root(x)) for x in list(up))


def chain(ids):
    return list(zip(ids, ids[1:]))


RNG = random.Random(3)
CASES = {
    "chain": chain(RNG.sample(range(10**9), 600)),
    "rising": chain(range(-50, 50)),
    "zigzag": chain([x for k in range(50) for x in (k, 1000 - k)]),
    "star": [(7, x) for x in range(200)],
    "mixed": [(RNG.randrange(300), RNG.randrange(300)) for _ in range(200)] + [(5, 5), (1000, 1000), (2, 3), (3, 2), (2, 3)],
    "none": [],
}


@pytest.mark.parametrize("name", CASES)
def test_components_in_few_rounds(spark, monkeypatch, name):
    written, real = [], components.materialize

    def counted(df):
        written.append(df)
        if len(written) > 60:
            raise AssertionError("the tables written grow with the length of a chain")
        return real(df)

    monkeypatch.setattr(components, "materialize", counted)
    links = CASES[name]
    df = spark.createDataFrame([*links, (1, None), (None, 2), (None, None)], "a long, b long")
    got = components.components(df)
    assert got.columns == ["node", "root"] and sorted(map(tuple, got.collect())) == expected(links)
