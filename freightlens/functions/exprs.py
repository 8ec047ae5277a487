"""Column expressions of shipments: periods, blanks, stream keys, change labels."""

from __future__ import annotations

import functools
from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The attributes that tell waste streams apart, in the order of the key.
STREAM_ATTRIBUTES = ("hazardous", "usdot_description", "nonhaz_description", "management_code", "form_code", "source_code", "container_code")
CHANGE = 0.05
UNKNOWN_WASTE = "Unknown Waste"


def blank_to_null(c: Column | str) -> Column:
    """Without blanks at the ends; null if nothing is left. Tabs are not blanks."""
    return F.nullif(F.btrim(c), F.lit(""))


def short_period(ts: Column | str) -> Column:
    """2018, second quarter: 20182. Never compare with long periods."""
    return (F.year(ts) * 10 + F.quarter(ts)).cast("int")


def long_period(ts: Column | str) -> Column:
    """2018, second quarter: 201802."""
    return (F.year(ts) * 100 + F.quarter(ts)).cast("int")


def quarter_bounds(year: int, quarter: int) -> tuple[date, date]:
    """First day of a quarter and of the next."""
    if quarter not in (1, 2, 3, 4):
        raise ValueError(f"no quarter {quarter}")
    month = 3 * quarter - 2
    return date(year, month, 1), date(year + quarter // 4, month % 12 + 3 if quarter < 4 else 1, 1)


def in_quarters(ts: Column, quarters: Iterable[int]) -> Column:
    """Timestamps of any of the quarters (long periods): half-open ranges, one for quarters that follow each other,
    so that a scan can skip what is outside."""
    spans: list[tuple[date, date]] = []
    for a, b in sorted(quarter_bounds(*divmod(q, 100)) for q in quarters):
        spans = [*spans[:-1], (spans[-1][0], b)] if spans and spans[-1][1] == a else [*spans, (a, b)]
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return functools.reduce(lambda x, y: x | y, [(ts >= at(a)) & (ts < at(b)) for a, b in spans], F.lit(False))


def stream_key() -> Column:
    """md5 of the attributes joined by bars; a missing one counts as empty."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(a), F.lit("")) for a in STREAM_ATTRIBUTES]))


def change_label(now: Column, after: Column, threshold: float = CHANGE) -> Column:
    """increase, same or decrease, the threshold included; null without a next value. From zero only a
    rise is a change."""
    change = (after - now) / F.nullif(now, F.lit(0.0))
    return (
        F.when(after.isNull(), F.lit(None).cast("string"))
        .when((now == 0) & (after > 0), "increase")
        .when((now == 0) & (after == 0), "same")
        .when(change >= threshold, "increase")
        .when(change <= -threshold, "decrease")
        .otherwise("same")
    )


def lag_sum(names: list[str]) -> Column:
    total = F.lit(0.0)
    for n in names:
        total = total + F.coalesce(F.col(n), F.lit(0.0))
    return total


def lag_ratio(now: Column, names: list[str]) -> Column:
    """now over the mean of the lags; missing lags count as zero in it. Null where they sum to zero."""
    return now / F.nullif(lag_sum(names) / len(names), F.lit(0.0))


def class_index(label: Column) -> Column:
    """decrease 0, increase 2, anything else 1."""
    return F.when(label == "decrease", 0).when(label == "increase", 2).otherwise(1)
