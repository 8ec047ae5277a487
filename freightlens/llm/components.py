"""Connected components of a table of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of `links`: root is the smallest node that links reach. A round sends each node to its
    least neighbour, from there to that one's, and so on, 2**k times in round k, and puts the ends of the links in place of
    the nodes. So what is left shrinks, chains included, and the rounds grow with the logarithm of a component's nodes.
    Every round is a written table, so a lost executor costs one round's tasks. Links may repeat; nulls link nothing."""
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    edges = materialize(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    rounds: list[DataFrame] = []
    while not rounds or not edges.isEmpty():
        to = materialize(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("_v")).select("node", F.least("node", "_v").alias("root")))
        for _ in rounds:
            before, to = to, materialize(_onward(to, to))
            discard(before)
        end = lambda x: to.select(F.col("node").alias(x), F.col("root").alias(f"_{x}"))  # noqa: B023, E731
        left = edges.join(end("u"), "u").join(end("v"), "v").filter("_u <> _v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
        before, edges = edges, materialize(left.distinct())
        discard(before)
        rounds.append(to)
    roots = rounds[-1]
    for to in reversed(rounds[:-1]):
        roots = _onward(to, roots)
    if len(rounds) > 1:
        roots = materialize(roots)
        discard(*rounds)
    discard(edges)
    return roots


def _onward(to: DataFrame, then: DataFrame) -> DataFrame:
    """`to` with each root sent on to its own root in `then`, if it is a node there."""
    far = then.select(F.col("node").alias("root"), F.col("root").alias("_far"))
    return to.join(far, "root", "left").select("node", F.coalesce("_far", "root").alias("root"))
