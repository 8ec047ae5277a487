"""Categories of any size as sparse features: levels are numbered in a table, and rows find theirs by a join.

A category with n levels takes n - 1 places, as one column for each level but the first would; the first level, one that is not
in the table and null have no place. Nothing of a level's size comes to the driver but the number of levels.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes, OneVsRest
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import class_index
from ..sources.tables import written
from .graph import numbered
from .ml import IDS


def levels(sources: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """category, level and position, from 0 in order of the levels, of each category's column; nulls are no level."""
    every = None
    for name, (df, column) in sources.items():
        one = df.select(F.lit(name).alias("category"), F.col(column).cast("string").alias("level")).filter("level is not null").distinct()
        every = one if every is None else every.unionByName(one)
    ids = written(numbered(every, ["category", "level"], "_id"))
    first = ids.groupBy("category").agg(F.min("_id").alias("_first"))
    return written(ids.join(F.broadcast(first), "category").select("category", "level", (F.col("_id") - F.col("_first")).cast("int").alias("position")))


def sizes(table: DataFrame) -> dict[str, int]:
    """Number of levels of each category: one row a category."""
    return {r.category: r.n for r in table.groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()}


def complete_rows(df: DataFrame, categories: Sequence[str]) -> DataFrame:
    """uid, label, numbers and categories of the simple view: rows with any null go, and texts that are no category."""
    out = df.withColumn("label", class_index(F.col("target_class"))).drop(*[c for c in IDS if c not in ("uid", *categories)])
    texts = [f.name for f in out.schema if isinstance(f.dataType, T.StringType) and f.name not in categories]
    return out.drop(*texts).na.drop("any")


def with_places(df: DataFrame, table: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Each category's text replaced by its place, from 0; null where it has none. Spark sends a category's levels to
    all tasks only if they are few enough for its own bound."""
    for c in categories:
        mine = table.filter((F.col("category") == c) & (F.col("position") > 0)).select(F.col("level").alias("_level"), (F.col("position") - 1).alias("_place"))
        df = df.join(mine, F.col(c).cast("string") == F.col("_level"), "left").drop(c, "_level").withColumnRenamed("_place", c)
    return df


def numbers_of(placed: DataFrame, categories: Sequence[str]) -> list[str]:
    return [c for c in placed.columns if c not in ("uid", "label", *categories)]


def entries(placed: DataFrame, categories: Sequence[str], n_levels: Mapping[str, int]) -> DataFrame:
    """uid, index and value of each feature that is not 0: numbers first, then the categories one after the other."""
    numbers = numbers_of(placed, categories)
    cells = [F.struct(F.lit(i).alias("index"), F.col(c).cast("double").alias("value")) for i, c in enumerate(numbers)]
    at = len(numbers)
    for c in categories:
        cells.append(F.struct((F.col(c) + at).alias("index"), F.lit(1.0).alias("value")))
        at += max(0, n_levels.get(c, 0) - 1)
    return placed.select("uid", F.explode(F.array(*cells)).alias("e")).select("uid", "e.*").filter("index is not null and value <> 0")


def features(placed: DataFrame, categories: Sequence[str], n_levels: Mapping[str, int]) -> DataFrame:
    """uid, label and features, a sparse vector in the order of `entries`."""
    numbers = numbers_of(placed, categories)
    used = [c for c in categories if n_levels.get(c, 0) > 1]
    for c in used:
        # The encoder leaves the last of num_vals values out: here the one for rows without a place.
        place = F.coalesce(F.col(c), F.lit(n_levels[c] - 1)).cast("double")
        placed = placed.withColumn(f"{c}_at", place.alias(f"{c}_at", metadata={"ml_attr": {"type": "nominal", "num_vals": n_levels[c]}}))
    if used:
        encoder = OneHotEncoder(inputCols=[f"{c}_at" for c in used], outputCols=[f"{c}_v" for c in used], dropLast=True)
        placed = encoder.fit(placed).transform(placed)
    return VectorAssembler(inputCols=[*numbers, *[f"{c}_v" for c in used]], outputCol="features").transform(placed).select("uid", "label", "features")


def fit(train: DataFrame, kind: str) -> PipelineModel:
    """kind: bayes (features must not be negative) or logistic, as for columns."""
    last = {"bayes": lambda: NaiveBayes(modelType="multinomial", smoothing=1.0), "logistic": lambda: OneVsRest(classifier=LogisticRegression(maxIter=1000, tol=1e-3))}[kind]()
    return Pipeline(stages=[last]).fit(train)
