"""From feature views to classifiers: split, one-hot, null policy, models and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import class_index

#: Remainders of uid by 100, [from, to).
SPLITS = {"train": (0, 70), "validation": (70, 85), "test": (85, 100)}
IDS = ("uid", "quarter_start", "facility", "waste_code", "waste_stream_key", "display_name", "first_shipped_date", "last_shipped_date", "target_class", "next_qty_tons")


def split(df: DataFrame, part: str) -> DataFrame:
    lo, hi = SPLITS[part]
    return df.filter((F.col("uid") % 100 >= lo) & (F.col("uid") % 100 < hi))


def split_name(uid: Column) -> Column:
    r = uid % 100
    return F.when(r < SPLITS["train"][1], "train").when(r < SPLITS["validation"][1], "validation").otherwise("test")


def levels(df: DataFrame, column: str, most: int = 1000) -> list[str]:
    """The sorted values of a category, nulls left out. Each becomes a column, so more than `most` are an error."""
    found = df.select(F.col(column).cast("string").alias("v")).filter("v is not null").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values and is no category")
    return sorted(r.v for r in found)


def domains(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    return {c: levels(df, c) for c in columns}


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """A 0/1 column for each value but the first; unknown or null gives zeros. The category itself goes."""
    new = {f"{column}_{v}": F.when(F.col(column) == v, 1).otherwise(0) for v in values[1:]}
    return df.withColumns(new).drop(column) if new else df.drop(column)


def page(df: DataFrame, size: int, number: int) -> DataFrame:
    return df.orderBy("uid").offset(size * number).limit(size)


def transform_simple(df: DataFrame, domains: dict[str, Sequence[str]]) -> DataFrame:
    """uid, label and features of the simple view; rows with any null go, and texts that are no category."""
    out = df.withColumn("label", class_index(F.col("target_class"))).drop(*[c for c in IDS if c not in ("uid", *domains)])
    texts = [f.name for f in out.schema if isinstance(f.dataType, T.StringType) and f.name not in domains]
    out = out.drop(*texts).na.drop("any")
    for c, values in domains.items():
        out = one_hot(out, c, values)
    return out


def transform_graph(df: DataFrame, domains: dict[str, Sequence[str]], keep_next: bool = False) -> DataFrame:
    """uid, label and features of the graph view: rows with a null lag go, other null numbers become 0.
    keep_next leaves next_qty_tons in, which gives the label away."""
    drop = [c for c in IDS if c not in ("uid", *domains) and not (keep_next and c == "next_qty_tons")]
    out = df.withColumn("label", class_index(F.col("target_class"))).drop(*drop)
    texts = [f.name for f in out.schema if isinstance(f.dataType, T.StringType) and f.name not in domains]
    out = out.drop(*texts)
    lags = [c for c in out.columns if "lag" in c]
    numbers = [f.name for f in out.schema if isinstance(f.dataType, T.NumericType) and f.name not in (*lags, "label", "uid", "next_qty_tons")]
    out = out.na.drop(subset=lags).na.fill(0, subset=numbers)
    for c, values in domains.items():
        out = one_hot(out, c, values)
    return out


def features_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("uid", "label")]


def clamp(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Negative numbers become 0, as counts must be for naive Bayes."""
    return df.withColumns({c: F.greatest(F.col(c).cast("double"), F.lit(0.0)) for c in columns})


def fit(train: DataFrame, kind: str, seed: int = 7) -> PipelineModel:
    """kind: logistic (one against the rest), bayes (multinomial; clamp first) or perceptron."""
    names = features_of(train)
    last = {
        "logistic": lambda: OneVsRest(classifier=LogisticRegression(maxIter=1000, tol=1e-3)),
        "bayes": lambda: NaiveBayes(modelType="multinomial", smoothing=1.0),
        "perceptron": lambda: MultilayerPerceptronClassifier(layers=[len(names), 64, 32, 3], maxIter=100, seed=seed),
    }[kind]()
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), last]).fit(train)


def fit_or_load(path: str, train: DataFrame, kind: str, seed: int = 7, again: bool = False) -> PipelineModel:
    """The model kept at `path`, fitted and kept first if there is none or `again` is asked for."""
    if not again:
        try:
            return PipelineModel.load(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    model = fit(train, kind, seed)
    model.write().overwrite().save(path)
    return model


def dump(df: DataFrame, path: str) -> None:
    """Features and labels as CSV folders `x` and `y`, rows in order of uid."""
    rows = df.orderBy("uid")
    rows.select(*features_of(df)).write.mode("overwrite").csv(f"{path}/x")
    rows.select("label").write.mode("overwrite").csv(f"{path}/y")


def pages_of(n: int, size: int) -> dict[str, int]:
    """Number of pages of `size` rows in each part of n rows."""
    return {part: -(-(n * (hi - lo)) // (100 * size)) for part, (lo, hi) in SPLITS.items()}


def confusion(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """label, support, precision, recall and f1 (0 where undefined) from a confusion matrix of a few rows. A class
    that is predicted and never occurs has support 0."""
    right = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    by_label = matrix.groupBy("label").agg(F.sum("n").alias("support"), right.alias("_hit"))
    by_guess = matrix.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("_guessed"))
    rows = by_label.join(by_guess, "label", "full").na.fill(0, ["support", "_hit", "_guessed"])
    ratio = lambda a, b: F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumns({"precision": ratio(F.col("_hit"), F.col("_guessed")), "recall": ratio(F.col("_hit"), F.col("support"))})
    return rows.select("label", "support", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def overall(matrix: DataFrame) -> DataFrame:
    """accuracy and balanced accuracy (mean recall of the classes that occur)."""
    return class_metrics(matrix).agg((F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))
