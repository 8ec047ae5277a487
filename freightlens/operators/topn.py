"""The n greatest of a key, ties broken by the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The longest list: it is sent to all tasks.
MOST = 100_000


def top_n(df: DataFrame, key: str, measure: Column, n: int, name: str) -> DataFrame:
    """key and `name` for the n keys of greatest measure, null measures last. n rows, whatever the data."""
    if n > MOST:
        raise ValueError(f"a list of more than {MOST} keys is too long to send to all tasks")
    ranked = df.filter(F.col(key).isNotNull()).groupBy(key).agg(measure.alias(name))
    return ranked.orderBy(F.desc_nulls_last(name), F.asc(key)).limit(n)


def among(df: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is one of `top`, which top_n made, so it is small enough to send to all tasks."""
    return df.join(F.broadcast(top.select(key)), key, "left_semi")
