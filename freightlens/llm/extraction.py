"""Main text of web pages by gradient-boosted trees over elements.

The trees are fitted with Spark ML on generated layouts (PAGES of them, a fixed number) once, and kept in the folder
that all executors share; their features are subtree density, hashed words of attributes, depth and sibling
statistics. Each page is read into a tree, all its elements are scored, and the choice that is kept is the likeliest
one in which no element is kept below a dropped one.
"""

from __future__ import annotations

import hashlib
import inspect
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dom, page_maker
from .common import remove, scratch
from .dom import Tree, unpacked
from .page_maker import Maker

PAGES, ROUNDS, DEPTH = 1200, 40, 5
#: Elements scored together.
ROWS = 1 << 14
NODES = "tree int, node int, weight double, feature int, threshold double, left int, right int, value double"


def training_rows(spark: SparkSession, pages: int = PAGES) -> DataFrame:
    """features, label: one row per element of `pages` generated pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, y = [], []
            for seed in b["id"]:
                tree = Tree(Maker(int(seed)).page())
                x += unpacked(*tree.features()).tolist()
                y += tree.labels()
            yield pd.DataFrame({"x": x, "label": np.array(y, float)})

    rows = spark.range(0, pages, 1, 3).mapInPandas(run, "x array<double>, label double")
    return rows.select(array_to_vector("x").alias("features"), "label")


def fit(spark: SparkSession, pages: int = PAGES, rounds: int = ROUNDS, depth: int = DEPTH) -> list[tuple]:
    """Trees as arrays: weight, feature (-1 at a leaf), threshold, left, right, value."""
    rows = training_rows(spark, pages).persist()
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=5, maxBins=32).fit(rows)
    rows.unpersist()
    return arrays(spark, model)


def arrays(spark: SparkSession, model: GBTClassificationModel) -> list[tuple]:
    """From the node table that Spark saves with a model: some thousand rows."""
    path = f"{scratch(spark)}/trees-{uuid.uuid4().hex}"
    model.save(path)
    split = F.col("nodeData.split")
    threshold = F.get(split["leftCategoriesOrThreshold"], 0).alias("threshold")
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"), split["featureIndex"].alias("feature"), threshold, "nodeData.leftChild", "nodeData.rightChild", "nodeData.prediction")
    table = nodes.toPandas().sort_values(["tree", "node"])
    remove(spark, path)
    out = []
    for k, t in table.groupby("tree"):
        leaf = (t.leftChild < 0).to_numpy()
        kept = lambda c, other: np.where(leaf, other, t[c].to_numpy())
        out.append((model.treeWeights[k], kept("feature", -1).astype(int), kept("threshold", 0.0).astype(float), kept("leftChild", t.node).astype(int), kept("rightChild", t.node).astype(int), t.prediction.to_numpy()))
    return out


def trees(spark: SparkSession) -> list[tuple]:
    """The trees as kept in the shared folder; they are fitted and kept first if there are none of this code."""
    code = "".join([inspect.getsource(dom), inspect.getsource(page_maker), f"{PAGES} {ROUNDS} {DEPTH}"])
    path = f"{scratch(spark)}/main-text-{hashlib.md5(code.encode()).hexdigest()}"
    try:
        rows = spark.read.schema(NODES).parquet(path).toPandas().sort_values(["tree", "node"])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = pd.DataFrame()
    if len(rows):
        columns = ("feature", "threshold", "left", "right", "value")
        return [(t.weight.iloc[0], *[t[c].to_numpy() for c in columns]) for _, t in rows.groupby("tree")]
    fitted = fit(spark)
    rows = [(k, i, float(w), *map(lambda x: x.item(), node)) for k, (w, *columns) in enumerate(fitted) for i, node in enumerate(zip(*columns))]
    spark.createDataFrame(rows, NODES).coalesce(1).write.mode("overwrite").parquet(path)
    return fitted


def scores(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    """Probability of being content for each row of features."""
    margin = np.zeros(len(x))
    rows = np.arange(len(x))
    for weight, feature, threshold, left, right, value in trees:
        at = np.zeros(len(x), np.int64)
        while (inner := feature[at] >= 0).any():
            f = feature[at]
            at = np.where(inner, np.where(x[rows, f] <= threshold[at], left[at], right[at]), at)
        margin += weight * value[at]
    return 1 / (1 + np.exp(-2 * margin))


def main_text(pages: list[str | None], trees: list[tuple]) -> list[str]:
    parsed = [Tree(p or "") for p in pages]
    numbers, packed = (np.concatenate(x) for x in zip(*[t.features() for t in parsed]))
    p = np.concatenate([scores(trees, unpacked(numbers[a : a + ROWS], packed[a : a + ROWS])) for a in range(0, len(numbers), ROWS)])
    out, at = [], 0
    for t in parsed:
        out.append(t.text(t.decode(p[at : at + len(t.tag)].tolist())))
        at += len(t.tag)
    return out


def extract(pages: DataFrame, trees: list[tuple], *, html: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text of each whole page (a column named `out` is replaced).

    - null or empty html, or no content found: the empty text. Extra columns stay; repeated pages give
      equal texts; empty table: empty result
    - character references are decoded, white space becomes one blank, blocks are joined by one blank
    - scripts, styles, the head and hidden elements are never text
    - very long pages and odd markup: read whole, in time that grows with their length; elements nest 512 deep
      at most, deeper ones stand beside each other. Ties between keeping and dropping an element: it is kept
    """
    given = pages.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("string")
    def texts(htmls: pd.Series) -> pd.Series:
        got = []
        for a in range(0, len(htmls), 64):
            got += main_text([h if isinstance(h, str) else None for h in htmls.iloc[a : a + 64]], given.value)
        return pd.Series(got, dtype=object)

    return pages.withColumn(out, texts(F.col(html)))
