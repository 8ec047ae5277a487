"""The shipment graph: nodes, yearly edges, staged lines, waste streams and quarterly edges.

Nodes are named by (node_type, business_id) and streams by their key; surrogate ids come from `numbered`
where a consumer wants them.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import STREAM_ATTRIBUTES, UNKNOWN_WASTE, blank_to_null, long_period, stream_key
from ..sources.shipments import Shipments
from ..sources.tables import written
from .topn import among, top_n

START = date(2018, 1, 1)


def since(df: DataFrame, start: date | None) -> DataFrame:
    return df if start is None else df.filter(F.col("shipped") >= F.lit(start).cast("timestamp_ntz"))


def nodes(s: Shipments, start: date | None = START) -> DataFrame:
    """node_type, business_id, business_name, state_code: greatest name and state per role and id."""
    m = since(s.manifests, start)
    carried = s.carriers.join(m.select("mtn"), "mtn")

    def role(kind: str, df: DataFrame, key: str, name: str, state: Column) -> DataFrame:
        named = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("business_id"))
        return named.agg(F.max(name).alias("business_name"), F.max(state).alias("state_code")).select(F.lit(kind).alias("node_type"), "business_id", "business_name", "state_code")

    return (
        role("GENERATOR", m, "generator", "generator_name", F.col("generator_state"))
        .unionByName(role("FACILITY", m, "facility", "facility_name", F.col("facility_state")))
        .unionByName(role("TRANSPORTER", carried, "transporter", "transporter_name", F.lit(None).cast("string")))
    )


def numbered(df: DataFrame, keys: list[str], name: str, first: int = 1) -> DataFrame:
    """df with ids in order of its natural key, without a single-task window: rows are counted per range
    of keys, and the counts (one per partition) set each range's first id."""
    spread = written(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = spread.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    out = spread.withColumn("_rank", rank).join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_rank") + F.lit(first - 1)).drop("_part", "_rank", "_before")


def edges_with_ids(edges: DataFrame, named: DataFrame, ends: dict[str, str]) -> DataFrame:
    """edges with <end>_node_id for each end (column: node type), looked up among nodes that have graph_node_id;
    edges with an end that is no node go."""
    for end, kind in ends.items():
        ids = named.filter(F.col("node_type") == kind).select(F.col("business_id").alias(end), F.col("graph_node_id").alias(f"{end}_node_id"))
        edges = edges.join(ids, end)
    return edges


def _with_sums(m: DataFrame, s: Shipments) -> DataFrame:
    """m with _tons, _kg, _carriers and _codes of its manifests, each summed before it meets them. m keeps its
    partitions by mtn, which a full join of the sums would not."""
    amounts = s.lines.groupBy("mtn").agg(F.sum(F.coalesce("tons", F.lit(0.0))).alias("_tons"), F.sum(F.coalesce("kg", F.lit(0.0))).alias("_kg"))
    carriers = s.carriers.filter("transporter is not null").groupBy("mtn").agg(F.countDistinct("transporter").alias("_carriers"))
    codes = s.federal_codes.select("mtn", "code").unionByName(s.state_codes.select("mtn", "code")).filter("code is not null")
    codes = codes.groupBy("mtn").agg(F.countDistinct("code").alias("_codes"))
    return m.join(s.held(amounts), "mtn", "left").join(s.held(carriers), "mtn", "left").join(codes, "mtn", "left")


def year_edges(s: Shipments, kind: str, start: date | None = START) -> DataFrame:
    """Yearly edges GF, GT or TF. In GT and TF a manifest counts once per transporter row, and its tons
    with it. unique_transporters of GF and unique_waste_codes are sums of per-manifest distinct counts;
    unique_facilities and unique_generators are distinct counts. Repeated import rows count once."""
    m = since(s.manifests, start).withColumn("year", F.year("shipped"))
    zero = F.lit(0)
    common = [
        F.count(F.lit(1)).alias("manifest_count"), F.sum(F.coalesce("_tons", F.lit(0.0))).alias("total_waste_tons"), F.sum(F.coalesce("_kg", F.lit(0.0))).alias("total_waste_kg"),
        F.sum(F.coalesce("_codes", zero)).alias("unique_waste_codes"), F.min("shipped").alias("first_shipped_date"), F.max("shipped").alias("last_shipped_date"),
    ]
    if kind == "GF":
        base = m.filter("generator is not null and facility is not null").join(s.imports.distinct().withColumn("_import", F.lit(1)), "mtn", "left")
        keys = ["generator", "facility"]
        extra = [
            F.sum(F.coalesce("_carriers", zero)).alias("unique_transporters"),
            F.sum(F.when(F.col("rejection") == "Y", 1).otherwise(0)).alias("rejection_manifest_count"), F.sum(F.coalesce("_import", zero)).alias("import_manifest_count"),
        ]
    else:
        keys = {"GT": ["generator", "transporter"], "TF": ["transporter", "facility"]}[kind]
        base = m.join(s.carriers.select("mtn", "transporter"), "mtn").filter(" and ".join(f"{k} is not null" for k in keys))
        extra = [F.countDistinct("facility").alias("unique_facilities") if kind == "GT" else F.countDistinct("generator").alias("unique_generators")]
    rows = _with_sums(base, s)
    if s.parts:
        # Hardly any rows of one task share an edge, so they are dealt once, by edge, and not first by what is counted in it.
        rows = rows.repartition(s.parts, "year", *keys)
    return rows.groupBy("year", *keys).agg(*common, *extra)


def top_filters(s: Shipments, start: date | None = START, lines: int = 25, facilities: int = 100, generators: int = 50, transporters: int = 500) -> dict[str, DataFrame]:
    """Top line numbers, facilities, generators and transporters by rows, as key and row_count."""
    m, count = since(s.manifests, start), F.count(F.lit(1))
    dated = s.lines.join(m.select("mtn"), "mtn", "left_semi")
    carried = s.carriers.join(m.select("mtn"), "mtn")
    return {
        "line_no": top_n(dated, "line_no", count, lines, "row_count"),
        "facility": top_n(m, "facility", count, facilities, "row_count"),
        "generator": top_n(m, "generator", count, generators, "row_count"),
        "transporter": top_n(carried, "transporter", count, transporters, "row_count"),
    }


def _base(s: Shipments, tops: dict[str, DataFrame], start: date | None) -> DataFrame:
    m = since(s.manifests, start).filter("generator is not null and facility is not null")
    return among(among(m, tops["facility"], "facility"), tops["generator"], "generator").withColumns({"year": F.year("shipped"), "quarter": F.quarter("shipped"), "year_quarter": long_period("shipped")})


def stageable_quarters(s: Shipments, tops: dict[str, DataFrame], start: date | None = START) -> DataFrame:
    rows = _base(s, tops, start).join(among(s.lines, tops["line_no"], "line_no"), "mtn")
    counts = [F.countDistinct("mtn").alias("manifest_count"), F.count(F.lit(1)).alias("waste_line_count")]
    return rows.groupBy("year", "quarter", "year_quarter").agg(*counts).orderBy("year", "quarter")


def stage_lines(s: Shipments, tops: dict[str, DataFrame], start: date | None = START) -> DataFrame:
    """One row per manifest and waste line of the top lists, all quarters at once: blanks made null, the
    stream's key, and the manifest's number of top transporters."""
    base = _base(s, tops, start)
    carriers = among(s.carriers.filter("transporter is not null"), tops["transporter"], "transporter").join(base.select("mtn"), "mtn", "left_semi")
    carriers = carriers.groupBy("mtn").agg(F.countDistinct("transporter").alias("_carriers"))
    texts = ["hazardous", "usdot_description", "nonhaz_description", "management_code", "management_description", "form_code", "form_description", "source_code", "source_description", "container_code", "container_description"]
    lines = among(s.lines, tops["line_no"], "line_no").withColumns({c: blank_to_null(c) for c in texts})
    out = base.select("mtn", "shipped", "year", "quarter", "year_quarter", "generator", "facility").join(lines, "mtn").join(carriers, "mtn", "left")
    primary = F.coalesce("usdot_description", "nonhaz_description", F.lit(UNKNOWN_WASTE))
    return out.select(
        "mtn", "line_no", "shipped", "year", "quarter", "year_quarter", "generator", "facility", *texts, primary.alias("primary_description"),
        F.coalesce("tons", F.lit(0.0)).alias("tons"), F.coalesce("kg", F.lit(0.0)).alias("kg"), F.coalesce("_carriers", F.lit(0)).alias("unique_transporters"), stream_key().alias("waste_stream_key"),
    )


def stage_carriers(s: Shipments, staged: DataFrame, tops: dict[str, DataFrame]) -> DataFrame:
    """Distinct year_quarter, mtn, transporter of staged manifests."""
    pairs = among(s.carriers.filter("transporter is not null"), tops["transporter"], "transporter").select("mtn", "transporter").distinct()
    return staged.select("year_quarter", "mtn").distinct().join(pairs, "mtn").select("year_quarter", "mtn", "transporter")


def waste_streams(staged: DataFrame) -> DataFrame:
    """One row per key. Descriptions outside the key can differ under one key: the least row is taken."""
    also = ["management_description", "form_description", "source_description", "container_description"]

    def or_unknown(*names: str) -> Column:
        return F.coalesce(*names, F.lit("Unknown"))

    parts = [("Form", ("form_description", "form_code")), ("Mgmt", ("management_description", "management_code")), ("Source", ("source_description", "source_code")), ("Container", ("container_description", "container_code"))]
    display = F.concat(F.col("primary_description"), *[x for label, names in parts for x in (F.lit(f" | {label}: "), or_unknown(*names))])
    row = F.struct(*STREAM_ATTRIBUTES, "primary_description", *also, display.alias("display_name"))
    return staged.groupBy("waste_stream_key").agg(F.min(row).alias("_r")).select("waste_stream_key", "_r.*")


def quarter_edges(staged: DataFrame, carriers: DataFrame, kind: str) -> DataFrame:
    """Edges by quarter and stream. GF sums unique_transporters over lines; GT and TF repeat each line per
    transporter and count distinct facilities or generators."""
    rows = staged if kind == "GF" else staged.join(carriers, ["year_quarter", "mtn"])
    keys = {"GF": ["generator", "facility"], "GT": ["generator", "transporter"], "TF": ["transporter", "facility"]}[kind]
    extra = {"GF": F.sum("unique_transporters").alias("unique_transporters"), "GT": F.countDistinct("facility").alias("unique_facilities"), "TF": F.countDistinct("generator").alias("unique_generators")}[kind]
    return rows.groupBy("year", "quarter", "year_quarter", *keys, "waste_stream_key").agg(
        F.countDistinct("mtn").alias("manifest_count"), F.count(F.lit(1)).alias("waste_line_count"), F.sum("tons").alias("total_waste_tons"), F.sum("kg").alias("total_waste_kg"),
        extra, F.min("shipped").alias("first_shipped_date"), F.max("shipped").alias("last_shipped_date"),
    )
