"""Quarterly edges of a stream of lines: state by calendar quarter, a quarter's edges written when it closes.

The event time of a line is the end of its quarter, and the watermark follows the latest end by a delay. While a
quarter is open its lines are added up by edge and manifest, and these sums by edge; both are Spark's own aggregates, so the
state is partitioned by key and kept with the checkpoint. When the watermark passes a quarter's end, all of its
edges come out in one batch and are swapped in as one partition. A batch that is played again swaps in the same rows. Lines of
a closed quarter are dropped, and counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import snapshots
from ..sources.tables import read_or_empty, written
from .quarters import ENDS, KINDS

#: How long after a quarter's end, as the latest lines have it, lines of that quarter are still taken: until the
#: second quarter after it begins.
WAIT = "100 days"
LATE = "kind string, rows long, at timestamp"
#: The column that is counted by distinct values, and its name, beside the sum of unique_transporters for GF.
OTHER = {"GT": ("facility", "unique_facilities"), "TF": ("generator", "unique_generators")}


def feed(staged: DataFrame, carriers: DataFrame) -> DataFrame:
    """Staged lines as a stream takes them in: with the transporters of their manifest."""
    per = carriers.groupBy("year_quarter", "mtn").agg(F.collect_set("transporter").alias("transporters"))
    columns = ["mtn", "shipped", "year", "quarter", "year_quarter", "generator", "facility", "waste_stream_key", "tons", "kg", "unique_transporters"]
    return staged.select(*columns).join(per, ["year_quarter", "mtn"], "left")


def edge_stream(lines: DataFrame, kind: str, wait: str = WAIT) -> DataFrame:
    """Edges as `quarter_edges` gives them, from a stream of `feed` rows, each quarter when it closes. Lines without
    a time or without transporters (GT, TF) give none."""
    end = F.date_trunc("quarter", F.col("shipped").cast("timestamp")) + F.expr("INTERVAL 3 MONTHS")
    rows = lines.withColumn("_end", end)
    if kind != "GF":
        rows = rows.withColumn("transporter", F.explode("transporters"))
    keys = ["_end", "year", "quarter", "year_quarter", *ENDS[kind], "waste_stream_key"]
    other, name = OTHER.get(kind, (None, "unique_transporters"))
    seen = F.collect_set(other) if other else F.sum("unique_transporters")
    per = rows.withWatermark("_end", wait).groupBy(*keys, "mtn").agg(
        F.count(F.lit(1)).alias("_lines"), F.sum("tons").alias("_tons"), F.sum("kg").alias("_kg"), seen.alias("_seen"), F.min("shipped").alias("_first"), F.max("shipped").alias("_last"),
    )
    extra = F.size(F.array_distinct(F.flatten(F.collect_set("_seen")))).cast("bigint") if other else F.sum("_seen")
    out = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("manifest_count"), F.sum("_lines").alias("waste_line_count"), F.sum("_tons").alias("total_waste_tons"), F.sum("_kg").alias("total_waste_kg"),
        extra.alias(name), F.min("_first").alias("first_shipped_date"), F.max("_last").alias("last_shipped_date"),
    )
    return out.drop("_end")


def follow_edges(lines: DataFrame, root: str, kind: str, checkpoint: str, wait: str = WAIT) -> StreamingQuery:
    """Takes in what there is of a stream and keeps the edges of the quarters that close in `closed_<kind>`."""

    def keep(batch: DataFrame, number: int) -> None:
        rows = written(batch)
        closed = [r.year_quarter for r in rows.select("year_quarter").distinct().collect()]
        if closed:
            snapshots.replace(rows, f"{root}/closed_{kind.lower()}", "year_quarter", closed)

    query = edge_stream(lines, kind, wait).writeStream.outputMode("append").foreachBatch(keep)
    return query.option("checkpointLocation", f"{checkpoint}/{kind.lower()}").trigger(availableNow=True).start()


def dropped(query: StreamingQuery) -> int:
    """Rows that came after their quarter had closed, in the batches of this run."""
    first = lambda p: p["stateOperators"][-1] if p["stateOperators"] else {}
    return sum(int(first(p).get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress)


def take_in(lines: DataFrame, root: str, checkpoint: str, wait: str = WAIT, kinds: tuple[str, ...] = KINDS) -> dict[str, int]:
    """Runs `follow_edges` for each kind to the end of what there is, and keeps the number of late rows in `late`."""
    spark, late = lines.sparkSession, {}
    for kind in kinds:
        query = follow_edges(lines, root, kind, checkpoint, wait)
        query.awaitTermination()
        late[kind] = dropped(query)
    rows = spark.createDataFrame([(k, n) for k, n in late.items()], "kind string, rows long")
    rows.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/late")
    return late


def closed_edges(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The edges of the quarters that have closed."""
    return snapshots.read(spark, f"{root}/closed_{kind.lower()}")


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    """By kind, the rows that came too late in all runs."""
    return read_or_empty(spark, f"{root}/late", LATE).groupBy("kind").agg(F.sum("rows").alias("rows"))
