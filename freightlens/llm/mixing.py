"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of the budget, and a document's expected number of copies is its
share of that target. Whole copies are certain. The fraction left over is an inclusion probability
p, and documents are ranked by odds(U) / odds(p) with U uniform per document: the first of the
source, up to the words still wanted, get one copy more. That is Pareto sampling of a fixed size
with unequal probabilities.

The cut in each source is found from histograms of the rank, narrowed twice, so no window ever
holds a whole source. Sources are numbered by ranges and their shares found from sums, so none holds all sources.
All steps are DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, materialize, uniform

BINS = 1024
#: Parts in which equal rows are numbered, so that no task holds all of them.
SALTS = 1024
#: The columns that mixing adds.
OWN = ("_size", "source_size", "target", "_copies")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def water_level(df: DataFrame, by: Sequence[str], size: str, weight: str, total: Column, cap: float, out: str) -> DataFrame:
    """Shares `total` by `weight` among the few rows of each group `by`, none above cap * size; what a
    capped row leaves goes to the others by weight. Closed form: with rows in order of
    cap * size / weight, the first rows are capped, and the level of the rest is what remains over
    their weight."""
    need = (F.lit(float(cap)) * F.col(size)) / F.col(weight)
    order = Window.partitionBy(*by).orderBy(need)
    every = Window.partitionBy(*by)
    before = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    d = df.withColumns({"_need": need, "_full": F.lit(float(cap)) * F.sum(size).over(before), "_w": F.sum(weight).over(every) - F.sum(weight).over(before), "_total": total})
    # A row is capped if, with it and all rows before it capped, the level of the rest is not below its own.
    level = F.when(F.col("_w") > 0, (F.col("_total") - F.col("_full")) / F.col("_w")).otherwise(F.col("_total") - F.col("_full"))
    capped = F.when(F.col("_w") > 0, level >= F.col("_need")).otherwise(level >= 0)
    d = d.withColumn("_capped", capped)
    rest = F.col("_total") - F.lit(float(cap)) * F.coalesce(F.sum(F.when(F.col("_capped"), F.col(size))).over(every), F.lit(0))
    open_w = F.sum(F.when(~F.col("_capped"), F.col(weight))).over(every)
    share = F.when(F.col("_capped"), F.lit(float(cap)) * F.col(size)).otherwise(F.col(weight) * (rest / open_w))
    return d.withColumn(out, share).drop("_need", "_full", "_w", "_total", "_capped")


def shares(sources: DataFrame, budget: float, cap: float) -> DataFrame:
    """sources with target: `budget` times all source_size by _weight, none above cap * source_size. The level is
    raised until no more sources stop at their cap: a row of sums each time, and few times, since each raises it."""
    need = (F.lit(float(cap)) * F.col("source_size")) / F.col("_weight")
    level, total = -1.0, float(budget) * float(sources.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        capped = need <= F.lit(level)
        full, open_w = sources.agg(F.sum(F.when(capped, F.col("source_size"))), F.sum(F.when(~capped, F.col("_weight")))).first()
        if not open_w:  # all stop at their caps
            break
        higher = (total - float(cap) * (full or 0)) / open_w
        if higher <= level:
            break
        level = higher
    return sources.withColumn("target", F.when(need <= F.lit(level), F.lit(float(cap)) * F.col("source_size")).otherwise(F.col("_weight") * F.lit(level)))


def _weighted(by_source: DataFrame, weights: Sequence[int]) -> DataFrame:
    """by_source with _weight, the weights in turn by order of _src, null last: sources are numbered within ranges,
    and the ranges' counts (one row for each) say where each begins."""
    order = F.col("_src").asc_nulls_last()
    spread = materialize(by_source.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    counts = spread.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    at = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (at % len(weights) + 1).cast("int"))
    out = materialize(spread.join(F.broadcast(before), "_range").select("_src", "source_size", weight.alias("_weight")))
    discard(spread)
    return out


def measured(docs: DataFrame, *, doc_id="doc_id", text="text", source="source", short_words: int = 64, seed: str = "mix-1", keep: Sequence[str] | None = None) -> DataFrame:
    """_row (the columns `keep` of docs, all of them if None), _id, _src, _size, _class (of weight) and _odds of the
    document's uniform number, which depends on its id and its text."""
    u = uniform(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))), seed)
    rows = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("_row"), F.col(doc_id).alias("_id"), F.col(source).alias("_src"), n_words(F.col(text)).alias("_size"), u.alias("_u"))
    return rows.select("_row", "_id", "_src", "_size", F.when(F.col("_size") < short_words, 1).otherwise(2).alias("_class"), (F.col("_u") / (F.lit(1.0) - F.col("_u"))).alias("_odds"))


def _cut(ranked: DataFrame) -> DataFrame:
    """ranked: _src, _id, _size, _rank in [0, 1), _left (words wanted). Per source the last rank and
    id that the sample takes. A document is in if that brings the sum nearer to _left."""
    live = ranked.select("_src", "_id", "_size", "_rank", "_left", F.lit(0).cast("bigint").alias("_done"), F.col("_rank").alias("_pos"))
    for _ in range(2):
        live = live.withColumn("_bin", F.floor(F.col("_pos") * BINS).cast("int"))
        w = Window.partitionBy("_src").orderBy("_bin")
        hist = live.groupBy("_src", "_bin").agg(F.sum("_size").alias("_in"), F.max("_left").alias("_left"), F.max("_done").alias("_done"))
        hist = hist.withColumn("_upto", F.col("_done") + F.sum("_in").over(w))
        edge = hist.filter((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_in") < F.col("_left")))
        edge = edge.select("_src", "_bin", (F.col("_upto") - F.col("_in")).alias("_done"))
        # One row a source at most: Spark sends it to all tasks, or splits a hot source if it is large.
        live = live.drop("_done").alias("a").join(edge.alias("b"), F.col("a._src").eqNullSafe(F.col("b._src")) & (F.col("a._bin") == F.col("b._bin")))
        live = live.select("a._src", "_id", "_size", "_rank", "_left", "_done", (F.col("_pos") * BINS - F.col("a._bin")).alias("_pos"))
    units = live.groupBy("_src", "_rank", "_id").agg(F.sum("_size").alias("_in"), F.count("*").alias("_n"), F.max("_left").alias("_left"), F.max("_done").alias("_done"))
    w = Window.partitionBy("_src").orderBy("_rank", "_id")
    units = units.withColumn("_upto", F.col("_done") + F.sum("_in").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # Equal rows share a number; where the cut falls among them, a part of them is taken.
    split = (F.col("_n") > 1) & (F.col("_upto") > F.col("_left")) & (F.col("_upto") - F.col("_in") < F.col("_left"))
    at = F.struct("_rank", "_id")
    units = units.withColumn("_taken", 2 * F.col("_upto") - F.col("_in") <= 2 * F.col("_left"))
    # One of the first two is missing where the cut falls at an end of the bin.
    return units.groupBy("_src").agg(
        F.min(F.when(~F.col("_taken"), at)).alias("_out"), F.max(F.when(F.col("_taken"), at)).alias("_in"),
        F.max(F.when(split, at)).alias("_split"), F.max(F.when(split, (F.col("_left") - F.col("_upto") + F.col("_in")) / F.col("_in") * F.col("_n"))).alias("_wanted"),
    )


def plan(rows: DataFrame, *, weights: Sequence[int] = (5, 2, 1), budget: float = 1.0, max_copies: int = 3) -> DataFrame:
    """rows: _src, _id, _size, _class, _odds. One row per source and weight class: source_size, target, whole
    copies, the odds to divide by and the rank where the sample ends. Its size grows with the number of sources alone."""
    sizes = materialize(rows.groupBy("_src", "_class").agg(F.sum("_size").alias("_csize")))
    by_source = _weighted(sizes.groupBy("_src").agg(F.sum("_csize").alias("source_size")), weights)
    classes = sizes.alias("c").join(shares(by_source, budget, max_copies).alias("s"), F.col("c._src").eqNullSafe(F.col("s._src")))
    classes = classes.select(F.col("c._src").alias("_src"), "_class", "_csize", "source_size", "target", (F.col("_class") * F.col("_csize")).alias("_cweight"))
    # Sizes of zero take nothing and would divide by zero.
    some = water_level(classes.filter("_csize > 0"), ["_src"], "_csize", "_cweight", F.col("target"), max_copies, "_words")
    some = some.withColumn("_lambda", F.col("_words") / F.col("_csize"))
    some = some.withColumn("_whole", F.floor("_lambda").cast("bigint")).withColumn("_p", F.col("_lambda") - F.floor("_lambda"))
    every = Window.partitionBy("_src")
    some = some.withColumn("_left", F.sum(F.col("_p") * F.col("_csize")).over(every))
    some = some.withColumn("_mean", F.col("_left") / F.sum(F.when(F.col("_p") > 0, F.col("_csize"))).over(every))
    odds = F.when((F.col("_p") > 0) & (F.col("_mean") < 1), (F.col("_p") / (1 - F.col("_p"))) / (F.col("_mean") / (1 - F.col("_mean"))))
    some = materialize(some.withColumn("_by", odds).select("_src", "_class", "source_size", "target", "_whole", "_by", "_left"))
    ranked = rows.filter("_size > 0").alias("r").join(some.filter("_by is not null").alias("p"), F.col("r._src").eqNullSafe(F.col("p._src")) & (F.col("r._class") == F.col("p._class")))
    ranked = ranked.select("r._src", "_id", "_size", "_left", rank_of(F.col("_odds"), F.col("_by")).alias("_rank"))
    cut = materialize(_cut(ranked))
    none = classes.filter("_csize = 0").select("_src", "_class", "source_size", "target", F.lit(0).cast("bigint").alias("_whole"), F.lit(None).cast("double").alias("_by"), F.lit(0.0).alias("_left"))
    out = some.unionByName(none).alias("p").join(cut.alias("k"), F.col("p._src").eqNullSafe(F.col("k._src")), "left")
    out = materialize(out.select(F.col("p._src").alias("_src"), "_class", "source_size", "target", "_whole", "_by", "_left", "_out", "_in", "_split", F.round("_wanted").cast("bigint").alias("_wanted")))
    discard(some, cut, by_source, sizes)
    return out


def rank_of(odds: Column, by: Column) -> Column:
    """Pareto's rank odds(U) / odds(p), scaled by the source's mean and brought to [0, 1) in the same order."""
    x = odds / by
    return x / (F.lit(1.0) + x)


def mix_measured(rows: DataFrame, *, weights: Sequence[int] = (5, 2, 1), budget: float = 1.0, max_copies: int = 3) -> DataFrame:
    """rows as `measured` gives them. The columns of _row, then _size, source_size, target and _copies."""
    slim = ["_src", "_id", "_size", "_class", "_odds"]
    seen = materialize(rows.select(*slim))
    p = plan(seen, weights=weights, budget=budget, max_copies=max_copies)
    discard(seen)
    at = F.struct(rank_of(F.col("_odds"), F.col("_by")).alias("_rank"), F.col("_id"))
    # A source without a cut wants no words beyond its whole copies.
    taken = (
        F.when(F.col("_by").isNull(), 0)
        .when(F.col("_split").isNotNull(), (at < F.col("_split")).cast("int"))
        .when(F.col("_in").isNotNull(), (at <= F.col("_in")).cast("int"))
        .when(F.col("_out").isNotNull(), (at < F.col("_out")).cast("int"))
        .otherwise(0)
    )
    out = rows.alias("r").join(p.alias("p"), F.col("r._src").eqNullSafe(F.col("p._src")) & (F.col("r._class") == F.col("p._class")), "left")
    names = [c for c in rows.schema["_row"].dataType.names if c not in OWN]
    kept = [F.col("_row")[c].alias(c) for c in names]
    figures = ["_size", "source_size", "target"]
    if p.filter("_split is not null").isEmpty():
        return out.select(*kept, *figures, (F.col("_whole") + taken).alias("_copies"))
    inside = F.coalesce(F.col("_by").isNotNull() & (at == F.col("_split")), F.lit(False))
    apart = out.filter(~inside).select(*kept, *figures, (F.col("_whole") + taken).alias("_copies"))
    equal = materialize(out.filter(inside).select("_row", F.col("p._src").alias("_src"), *figures, "_whole", "_wanted", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("_salt")))
    return apart.unionByName(_first(equal).select(*kept, *figures, (F.col("_whole") + F.col("_first")).alias("_copies")))


def _first(equal: DataFrame) -> DataFrame:
    """equal: of each source the equal rows that the cut falls among, dealt into salts. _first is 1 for `_wanted` of them.
    One row is like another, so any of them will do; their number is what reruns must agree on."""
    sizes = equal.groupBy("_src", "_salt").agg(F.count("*").alias("_here"))
    before = F.sum("_here").over(Window.partitionBy("_src").orderBy("_salt")) - F.col("_here")
    sizes = sizes.select(F.col("_src").alias("_s"), F.col("_salt").alias("_t"), before.alias("_before"))
    rows = equal.join(sizes, F.col("_src").eqNullSafe(F.col("_s")) & (F.col("_salt") == F.col("_t")))
    number = F.row_number().over(Window.partitionBy("_src", "_salt").orderBy(F.lit(0)))
    return rows.withColumn("_first", (F.col("_before") + number <= F.col("_wanted")).cast("int"))


def mix(docs: DataFrame, *, doc_id="doc_id", text="text", source="source", weights: Sequence[int] = (5, 2, 1), budget: float = 1.0, max_copies: int = 3, short_words: int = 64, seed: str = "mix-1") -> DataFrame:
    """docs with _size, source_size, target and _copies.

    Size is the number of words. Documents of fewer than `short_words` words weigh half as much as
    the others of their source, so inclusion probabilities differ within a source.
    - null text: size 0, 0 copies. Null source: a source of its own, last in order.
    - repeated or null doc_id: rows of different texts are drawn apart. Rows of one id and one text share a random
      number; where the cut falls among them, as many as come nearest to the target are taken.
    - ties of rank: by doc_id. Very long texts are counted whole. Empty table: empty result.
    - columns of docs are kept but for those named _size, source_size, target and _copies, which are replaced.
    A source's taken words differ from its target by at most half the size of the document at the
    cut, unless its target is 0 or it has no words.
    """
    rows = measured(docs, doc_id=doc_id, text=text, source=source, short_words=short_words, seed=seed)
    return mix_measured(rows, weights=weights, budget=budget, max_copies=max_copies)
