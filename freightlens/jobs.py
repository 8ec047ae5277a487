"""Commands: ingest a database, build the graph, follow a stream of lines, write the feature views, pack them into pages,
train and evaluate a model, put the graph and the views into a database.

    python -m freightlens.jobs ingest settings.yaml
    python -m freightlens.jobs build --input DIR --root DIR [--mode stage|load|all] [--force] [--rebuild]
    python -m freightlens.jobs follow --lines DIR --root DIR --checkpoint DIR [--wait "100 days"]
    python -m freightlens.jobs views --input DIR --root DIR
    python -m freightlens.jobs pages --root DIR --view simple|graph --part train|validation|test [--size N]
    python -m freightlens.jobs export --root DIR --url JDBC_URL --schema NAME --batch ID [--mode replace|add]
    python -m freightlens.jobs train --root DIR --view simple|graph --kind logistic|bayes|perceptron|sgd|network|pages [--epochs N]

They end with 0, with 1 after an error and with 130 after an interruption.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import features, ml, training
from .sources import database, ingest
from .sources.shipments import Shipments, from_orders
from .streaming import edges, quarters

#: The categories that are one-hot encoded in each view.
CATEGORIES = {"simple": ("waste_code", "mode_form_code", "mode_source_code"), "graph": ("management_code", "form_code", "source_code")}


def clock(seconds: float) -> str:
    hours, rest = divmod(int(seconds), 3600)
    return f"{hours}h {rest // 60}m {rest % 60}s"


def build_graph(spark: SparkSession, s: Shipments, root: str, mode: str = "all", force: bool = False, rebuild: bool = False, **tops: int) -> str:
    """Nodes, yearly edges and the pending quarters, as one run; returns its id."""
    if rebuild and mode != "all":
        raise ValueError("a rebuild takes both steps")

    def work(run: str) -> None:
        if mode != "stage":
            quarters.refresh_nodes(spark, s, root)
            quarters.refresh_years(spark, s, root)
        quarters.build(spark, s, root, mode, force=force, run=run, rebuild=rebuild, **tops)

    return quarters.tracked_run(spark, root, mode, work)


def build_views(spark: SparkSession, s: Shipments, root: str, simple: dict | None = None, graph: dict | None = None) -> DataFrame:
    """Writes both views and registers them as simple_train_view and graph_train_view, the second from the loaded
    quarterly edges. Per view: rows and seconds."""
    gf, gt, tf = (quarters.edges(spark, root, k) for k in quarters.KINDS)
    streams = quarters.latest(spark, root, "streams")[1]
    done = []
    for name, make in (("simple", lambda: features.simple_view(s, **simple or {})), ("graph", lambda: features.graph_view(gf, gt, tf, streams, **graph or {}))):
        begin = time.monotonic()
        rows = ingest.materialized(make(), f"{root}/views/{name}", f"{name}_train_view").count()
        done.append((f"{name}_train_view", rows, time.monotonic() - begin))
    return spark.createDataFrame(done, "view string, rows bigint, seconds double")


def prepared(spark: SparkSession, root: str, view: str) -> DataFrame:
    """A written view as uid, label and features."""
    rows = spark.read.parquet(f"{root}/views/{view}")
    prepare = {"simple": ml.transform_simple, "graph": lambda df, d: ml.transform_graph(df.drop("year", "quarter"), d)}[view]
    return prepare(rows, ml.domains(rows, CATEGORIES[view]))


def train(spark: SparkSession, root: str, view: str, kind: str, again: bool = False, epochs: int = 10, batches: int = 1) -> DataFrame:
    """Reads a written view, discovers the levels of its categories, fits and keeps a model on the training part or
    takes the one that is kept, and writes the test part's confusion matrix and figures by class. Returns the latter.
    Kinds that train by pages go on from the last epoch that is kept, up to `epochs`."""
    rows = prepared(spark, root, view)
    if kind == "bayes":
        rows = ml.clamp(rows, ml.features_of(rows))
    path = f"{root}/models/{view}-{kind}"
    if kind in training.KINDS:
        model = training.fit_pages(rows, kind, epochs, batches=batches, path=f"{path}/epochs", again=again)
    else:
        model = ml.fit_or_load(f"{path}/model", ml.split(rows, "train"), kind, again=again)
    matrix = ingest.materialized(ml.confusion(model.transform(ml.split(rows, "test"))), f"{path}/confusion", f"{view}_{kind}_confusion")
    ingest.land(ml.overall(matrix), f"{path}/overall")
    return ingest.materialized(ml.class_metrics(matrix), f"{path}/metrics", f"{view}_{kind}_metrics")


def pages(spark: SparkSession, root: str, view: str, part: str, size: int = 1000) -> DataFrame:
    """All pages of a part of a written view for a loader, a page a row in order of its number, in `pages`. Returns the
    numbers of pages and rows."""
    rows = prepared(spark, root, view)
    path = f"{root}/pages/{view}-{part}"
    packed = training.packed(rows, [c for c in rows.columns if c not in ("uid", "label")], part, size)
    packed.drop("batch").repartitionByRange("page").sortWithinPartitions("page").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.size("uid")).alias("rows"))


def export(spark: SparkSession, root: str, url: str, schema: str, batch: str, mode: str = "replace", pause: float = 5.0) -> DataFrame:
    """Puts nodes, streams, edges and the written views into tables of a database, each by one transaction. Per table: its
    rows in this batch. Run again with the same batch, it goes on with the tables that are not there yet."""
    tables = {t: quarters.latest(spark, root, t)[1] for t in ("nodes", "streams", *(f"years_{k.lower()}" for k in quarters.KINDS))}
    tables |= {f"edges_{k.lower()}": quarters.edges(spark, root, k) for k in quarters.KINDS}
    tables |= {f"{v}_train_view": spark.read.parquet(f"{root}/views/{v}") for v in CATEGORIES}
    done = []
    for name, df in tables.items():
        if df is not None:
            done.append((name, batch, ingest.attempts(lambda: database.put(df, url, schema, name, batch, mode=mode, pause=pause), pause=pause)))  # noqa: B023
    return spark.createDataFrame(done, "table string, batch string, rows bigint")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="freightlens")
    jobs = p.add_subparsers(dest="job", required=True)
    jobs.add_parser("ingest").add_argument("settings")
    for name in ("build", "views"):
        j = jobs.add_parser(name)
        j.add_argument("--input", required=True)
        j.add_argument("--root", required=True)
        if name == "build":
            j.add_argument("--mode", choices=(*quarters.STEPS, "all"), default="all")
            j.add_argument("--force", action="store_true")
            j.add_argument("--rebuild", action="store_true")
    j = jobs.add_parser("follow")
    for name in ("lines", "root", "checkpoint"):
        j.add_argument(f"--{name}", required=True)
    j.add_argument("--wait", default=edges.WAIT)
    j = jobs.add_parser("train")
    j.add_argument("--root", required=True)
    j.add_argument("--view", choices=tuple(CATEGORIES), default="simple")
    j.add_argument("--kind", choices=("logistic", "bayes", "perceptron", *training.KINDS), default="logistic")
    j.add_argument("--again", action="store_true")
    j.add_argument("--epochs", type=int, default=10)
    j.add_argument("--batches", type=int, default=1)
    j = jobs.add_parser("pages")
    j.add_argument("--root", required=True)
    j.add_argument("--view", choices=tuple(CATEGORIES), default="simple")
    j.add_argument("--part", choices=tuple(ml.SPLITS), default="train")
    j.add_argument("--size", type=int, default=1000)
    j = jobs.add_parser("export")
    for name in ("root", "url", "schema", "batch"):
        j.add_argument(f"--{name}", required=True)
    j.add_argument("--mode", choices=database.MODES, default="replace")
    a, begin = p.parse_args(argv), time.monotonic()
    spark = SparkSession.builder.appName("freightlens").getOrCreate()
    try:
        if a.job == "ingest":
            out = ingest.run(spark, ingest.Settings.read(a.settings))
        elif a.job == "build":
            build_graph(spark, from_orders(spark, a.input), a.root, a.mode, a.force, a.rebuild)
            quarters.states(spark, a.root).orderBy("year_quarter").show(1000)
            out = quarters.progress(spark, a.root)
        elif a.job == "follow":
            lines = spark.readStream.schema(spark.read.parquet(a.lines).schema).parquet(a.lines)
            edges.take_in(lines, a.root, a.checkpoint, a.wait)
            out = edges.late_rows(spark, a.root)
        elif a.job == "export":
            out = export(spark, a.root, a.url, a.schema, a.batch, a.mode)
        elif a.job == "pages":
            out = pages(spark, a.root, a.view, a.part, a.size)
        elif a.job == "views":
            out = build_views(spark, from_orders(spark, a.input), a.root)
        else:
            out = train(spark, a.root, a.view, a.kind, a.again, a.epochs, a.batches).orderBy(F.col("label"))
        out.show(1000, truncate=False)
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001
        print(f"failed: {e}")
        return 1
    print(f"{a.job} took {clock(time.monotonic() - begin)}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
