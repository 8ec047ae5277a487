"""Quarterly feature views with lags, a next value and a three-class change label.

Lags go by existing rows: a missing quarter is passed over.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import CHANGE, change_label, lag_ratio, lag_sum, short_period
from ..sources.shipments import Shipments
from ..sources.tables import one_key_suffices, written
from .graph import numbered
from .topn import among, top_n


def base_lines(s: Shipments) -> DataFrame:
    """A row per manifest, waste line and federal code: a line with k codes gives its tons k times."""
    m = s.manifests.filter("shipped is not null and generator is not null and facility is not null")
    # Periods are found once a manifest, not once a line.
    m = m.select("mtn", "generator", "facility", short_period("shipped").alias("year_quarter"), F.date_trunc("quarter", "shipped").cast("date").alias("quarter_start"))
    rows = s.lines.filter("tons is not null").join(s.held(m), "mtn").join(s.held(s.federal_codes.filter("code is not null")), ["mtn", "line_no"])
    return rows.select("year_quarter", "quarter_start", "generator", "facility", "line_no", F.col("code").alias("waste_code"), "tons", "management_code", "form_code", "source_code", "mtn")


def with_lags(df: DataFrame, keys: list[str], value: str, lags: int, more: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """df with lag_<i>, <column>_lag_1 for each of `more`, and next_qty_tons, of one window."""
    w = Window.partitionBy(*keys).orderBy("year_quarter")
    new = {f"qty_tons_lag_{i}": F.lag(value, i).over(w) for i in range(1, lags + 1)}
    new |= {f"{c}_lag_1": F.lag(c, 1).over(w) for c in more}
    return df.withColumns(new | {"next_qty_tons": F.lead(value, 1).over(w)})


def _labelled(df: DataFrame, value: str, lags: int, threshold: float) -> DataFrame:
    names, v = [f"qty_tons_lag_{i}" for i in range(1, lags + 1)], F.col(value)
    return df.filter("next_qty_tons is not null").withColumns({"lag_qty_sum": lag_sum(names), "qty_vs_lag_avg_ratio": lag_ratio(v, names), "target_class": change_label(v, F.col("next_qty_tons"), threshold)})


def _sums(s: Shipments) -> DataFrame:
    """_tons of base lines by facility and waste code, and by generator."""
    known = s.amounts() if s.amounts else None
    if known is not None:
        return known
    return base_lines(s).groupingSets([["facility", "waste_code"], ["generator"]], "facility", "waste_code", "generator").agg(F.sum("tons").alias("_tons"))


def simple_view(s: Shipments, codes: int = 25, facilities: int = 100, generators: int = 50, lags: int = 4, threshold: float = CHANGE) -> DataFrame:
    """By facility, waste code and quarter. The three top lists are cut on all base lines."""
    with one_key_suffices(s.lines.sparkSession):  # gathered lines and codes lie by mtn
        # One pass over the lines; sums by all three keys at once are nearly as many as the lines where keys have many values.
        sums = written(_sums(s))
        tops = {key: written(top_n(sums, key, F.sum("_tons"), n, "_tons").select(key)) for key, n in (("waste_code", codes), ("facility", facilities), ("generator", generators))}
        # The second pass looks up the manifests of the lists, which Spark sends to all tasks where they are few, and joins no others.
        s = s.only(tops["generator"]) if s.only else s
        m = among(among(s.manifests, tops["facility"], "facility"), tops["generator"], "generator").select("mtn", "shipped", "generator", "facility")
        m = written(m.filter("shipped is not null"))
        found = s.federal_codes.join(m.select("mtn"), "mtn", "left_semi").withColumnRenamed("code", "waste_code")
        listed = among(found, tops["waste_code"], "waste_code").withColumnRenamed("waste_code", "code")
        rows = base_lines(replace(s, manifests=m, federal_codes=listed, even=False))
        agg = rows.groupBy("year_quarter", "quarter_start", "facility", "waste_code").agg(
            F.count(F.lit(1)).alias("waste_line_row_count"), F.countDistinct("mtn").alias("manifest_count"), F.countDistinct("generator").alias("generator_count"),
            F.sum("tons").alias("qty_tons"), F.avg("tons").alias("avg_line_qty_tons"), F.stddev_samp("tons").alias("std_line_qty_tons"),
            *[F.mode(c, True).alias(f"mode_{c}") for c in ("management_code", "form_code", "source_code")],
        )
        keys = ["facility", "waste_code"]
        return numbered(_labelled(with_lags(agg, keys, "qty_tons", lags), "qty_tons", lags, threshold), [*keys, "year_quarter"], "uid")


def graph_view(gf: DataFrame, gt: DataFrame, tf: DataFrame, streams: DataFrame, facilities: int = 100, generators: int = 50, transporters: int = 500, lags: int = 4, threshold: float = CHANGE) -> DataFrame:
    """By facility, stream and quarter, from quarterly edges. The facility's own sums use the facility cut
    alone; pair features use the cuts of both ends; generator-transporter features are by stream and
    quarter, whatever the facility."""
    tons = F.sum("total_waste_tons")
    cut = {
        "facility": top_n(gf, "facility", tons, facilities, "_tons"),
        "generator": top_n(gf, "generator", tons, generators, "_tons"),
        "transporter": top_n(tf, "transporter", tons, transporters, "_tons"),
    }
    at = ["year_quarter", "facility", "waste_stream_key"]
    total = lambda c, name: F.sum(c).alias(name)

    def pairs(df: DataFrame, ends: tuple[str, str], by: list[str]):  # noqa: ANN202
        for e in ends:
            df = among(df, cut[e], e)
        return df.groupBy(*by)

    def repeated(name: str) -> Column:
        return F.count_if(F.col("manifest_count") >= 2).alias(name)

    own = among(gf, cut["facility"], "facility").groupBy("year", "quarter", *at).agg(
        total("manifest_count", "manifest_count"), total("waste_line_count", "waste_line_count"), total("total_waste_tons", "total_waste_tons"), total("total_waste_kg", "total_waste_kg"),
        total("unique_transporters", "unique_transporters_from_gf"), F.min("first_shipped_date").alias("first_shipped_date"), F.max("last_shipped_date").alias("last_shipped_date"),
    )
    gen = pairs(gf, ("facility", "generator"), at).agg(
        F.count(F.lit(1)).alias("generator_pair_count"), F.countDistinct("generator").alias("generator_count"), total("manifest_count", "pair_manifest_count_sum"), total("waste_line_count", "pair_waste_line_count_sum"),
        F.max("total_waste_tons").alias("max_generator_pair_tons"), F.avg("total_waste_tons").alias("avg_generator_pair_tons"), repeated("repeated_generator_pairs"), total("unique_transporters", "summed_unique_transporters_from_pairs"),
    )
    trn = pairs(tf, ("facility", "transporter"), at).agg(
        F.count(F.lit(1)).alias("transporter_pair_count"), F.countDistinct("transporter").alias("transporter_count"), total("manifest_count", "trans_fac_manifest_count_sum"), total("waste_line_count", "trans_fac_waste_line_count_sum"),
        F.max("total_waste_tons").alias("max_transporter_pair_tons"), F.avg("total_waste_tons").alias("avg_transporter_pair_tons"), repeated("repeated_transporter_pairs"), total("unique_generators", "summed_unique_generators_from_pairs"),
    )
    both = pairs(gt, ("generator", "transporter"), ["year_quarter", "waste_stream_key"]).agg(
        F.count(F.lit(1)).alias("global_gen_trans_pair_count"), F.countDistinct("generator").alias("global_gen_trans_generator_count"), F.countDistinct("transporter").alias("global_gen_trans_transporter_count"),
        total("manifest_count", "global_gen_trans_manifest_count_sum"), total("waste_line_count", "global_gen_trans_waste_line_count_sum"), F.max("total_waste_tons").alias("global_max_gen_trans_pair_tons"),
    )
    rows = own.join(gen, at, "left").join(trn, at, "left").join(both, ["year_quarter", "waste_stream_key"], "left")
    filled = [c for df in (gen, trn, both) for c in df.columns if c not in at]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in filled})
    kept = streams.select("waste_stream_key", "display_name", "management_code", "form_code", "source_code")
    rows = rows.join(kept, "waste_stream_key")
    more = ["manifest_count", "generator_count", "transporter_count", "generator_pair_count", "transporter_pair_count"]
    keys = ["facility", "waste_stream_key"]
    out = _labelled(with_lags(rows, keys, "total_waste_tons", lags, more), "total_waste_tons", lags, threshold)
    out = out.withColumns({f"{c}_qoq_delta": F.col(c) - F.col(f"{c}_lag_1") for c in more})
    return numbered(out, [*keys, "year_quarter"], "uid")
