"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells.

Equal vectors become one first. Spherical k-means is fitted on a bounded sample, and each vector is stored in the
cell of its nearest centre. It is sent as a probe to that cell and to those whose border is near: nearer than
`reach` times the chord of the threshold. With reach 1 no link can be missed, whatever the vectors. In d dimensions
the difference of two near vectors has about 1/sqrt(d) of its length across any one border, and a pair is missed only
if it crosses the border by more than twice the reach, so the usual reach is SPREAD / sqrt(d).

Vectors of different lengths never link, so each length has its own centres; one with a block of vectors at most, which
is compared within that block, has a cell without any, unless it is the commonest.

Cells grow in number with the vectors, so that a cell's size does not: beyond MAX_CENTRES cells a second set of
centres, fitted with another seed, divides each cell of the first. A cell that is large all the same is split in blocks.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, hashed_share, materialize
from .components import components

#: The most vectors of a length that its centres are fitted on; every vector is indexed.
MAX_FIT = 50_000
#: Vectors of a cell, about, and the most centres of each of the two sets: room for a thousand million vectors of a length.
PER_CELL, MAX_CENTRES = 1000, 1024
#: The most cells whose sizes are sent to all tasks, a row of three numbers each; those of more are joined by a shuffle.
MAX_SENT = MAX_CENTRES**2
#: Stored vectors and probes that meet in one task.
BLOCK, PROBES = 2048, 16384
SPREAD = 0.8
#: Parts that the vectors of one component are dealt over where they meet their component's least id.
SALTS = 16


def usable(v: Column) -> Column:
    """False for null, empty and zero vectors and those with null or non-finite components."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Unit rows, in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centres(vectors: DataFrame, n: int, seed: int) -> list[np.ndarray]:
    """Two sets of unit centres from a sample of the n vectors; the second has one centre while the first is enough."""
    k = min(n, max(2, math.ceil(n / PER_CELL)))
    first = min(k, MAX_CENTRES)
    out = [np.zeros((1, 1)), np.zeros((1, 1))]
    if first < 2:
        return out
    sample = materialize(vectors.filter(hashed_share(F.col("h"), MAX_FIT, n)).select(array_to_vector(F.col("v").cast("array<double>")).alias("features")))
    for i, size in enumerate((first, min(MAX_CENTRES, math.ceil(k / first)))):
        if size > 1:
            c = np.array(KMeans(k=size, maxIter=5, seed=seed + i, distanceMeasure="cosine", initMode="random").fit(sample).clusterCenters())
            out[i] = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
    discard(sample)
    return out


def _near(x: np.ndarray, c: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row of x, and which centres' cells have their border within `limit` of it."""
    if len(c) < 2:
        return np.zeros(len(x), np.int64), np.ones((len(x), 1), bool)
    gap = np.sqrt(np.maximum(2 - 2 * c @ c.T, 1e-12))
    dot, rows = x @ c.T, np.arange(len(x))
    best = dot.argmax(axis=1)
    to = (dot[rows, best][:, None] - dot) <= limit * gap[best]
    to[rows, best] = True
    return best, to


def _cells(vectors: DataFrame, centres: list[np.ndarray], start: int, threshold: float, reach: float) -> DataFrame:
    """h, v, copies, own (cell) and near (cells to probe, own among them) of vectors of one length, whose cells are
    numbered from `start`."""
    given = vectors.sparkSession.sparkContext.broadcast(centres)
    limit = reach * math.sqrt(2 - 2 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, width = _matrix(b.column("v")), len(given.value[1])
            (first, some), (second, more) = (_near(x, c, limit) for c in given.value)
            own = start + first * width + second
            near = [(start + np.flatnonzero(f)[:, None] * width + np.flatnonzero(s)).ravel().tolist() for f, s in zip(some, more)]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("v"), b.column("copies"), pa.array(own.astype(np.int64)), pa.array(near, pa.list_(pa.int64()))], names=["h", "v", "copies", "own", "near"])

    kind = vectors.schema["v"].dataType.simpleString()
    return vectors.select("h", "v", "copies").mapInArrow(run, f"h long, v {kind}, copies long, own long, near array<long>")


def _indexed(distinct: DataFrame, threshold: float, reach: float | None, seed: int) -> tuple[DataFrame, int]:
    """The cells of all vectors, and the most cells there are. A length of more than a block of vectors, and the
    commonest one, has its own centres; each other length is one cell."""
    lengths = distinct.groupBy(F.size("v").alias("d")).count()
    top = lengths.orderBy(F.desc("count"), "d").first()
    alone = F.array(-F.size("v").cast("bigint"))
    if not top:
        return distinct.select("h", "v", "copies", alone[0].alias("own"), alone.alias("near")), 0
    # At most one in BLOCK vectors has a length of its own here.
    large = lengths.filter(F.col("count") > BLOCK).orderBy("d").collect() if top["count"] > BLOCK else [top]
    parts, start = [], 0
    for r in large:
        some = distinct.filter(F.size("v") == r["d"])
        centres = _centres(some, r["count"], seed)
        parts.append(_cells(some, centres, start, threshold, min(1.0, SPREAD / math.sqrt(r["d"])) if reach is None else reach))
        start += len(centres[0]) * len(centres[1])
    others = lengths.count() - len(large)
    if others:
        rest = distinct.filter(~F.size("v").isin([r["d"] for r in large]))
        parts.append(rest.select("h", "v", "copies", alone[0].alias("own"), alone.alias("near")))
    return functools.reduce(DataFrame.unionByName, parts), start + others


def _compared(tasks: DataFrame, threshold: float) -> DataFrame:
    """tasks: rows of one cell block each, stored ones before probes. Rows (a, b): links that join what
    this block joins; rows (a, null, n, _): a's links seen here, n of them counted with multiplicity."""

    def close(h: list, label: np.ndarray, counts: dict[int, int]) -> pa.RecordBatch:
        a, b, n = list(counts), [None] * len(counts), list(counts.values())
        for i in np.flatnonzero(label != np.arange(len(label))):
            a.append(h[i])
            b.append(h[label[i]])
            n.append(0)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stored, x = None, [], np.empty((0, 0))
        h, copies, near, label, counts = np.empty(0, np.int64), np.empty(0, np.int64), [], np.empty(0, np.int64), {}
        for batch in batches:
            tasks_, probes = batch.column("task").to_numpy(), batch.column("probe").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((tasks_[1:] != tasks_[:-1]) | (probes[1:] != probes[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, len(tasks_)]):
                part = batch.slice(lo, hi - lo)
                if tasks_[lo] != now:
                    if now is not None:
                        yield close(h, label, counts)
                    now, stored, counts = tasks_[lo], [], {}
                    h, label = np.empty(0, np.int64), np.empty(0, np.int64)
                if not probes[lo]:
                    stored.append(part)
                    continue
                if stored:  # all of this block's stored vectors have come
                    t = pa.Table.from_batches(stored).combine_chunks()
                    x, h, copies = _matrix(t.column("v").combine_chunks()), t.column("h").to_numpy(), t.column("copies").to_numpy()
                    near, label, stored = [set(c) for c in t.column("near").to_pylist()], np.arange(t.num_rows), []
                if not len(h):
                    continue
                ph, pc, own = part.column("h").to_numpy(), part.column("copies").to_numpy(), part.column("own").to_numpy()
                hit = _matrix(part.column("v")) @ x.T >= threshold
                hit &= ph[:, None] != h[None, :]
                links = []
                for i in np.flatnonzero(hit.any(axis=1)):
                    at = np.flatnonzero(hit[i])
                    p = int(ph[i])
                    counts[p] = counts.get(p, 0) + int(copies[at].sum())
                    # The stored vector's own probe misses this one's cell: count the link for it here.
                    for j in at:
                        if int(own[i]) not in near[j]:
                            counts[int(h[j])] = counts.get(int(h[j]), 0) + int(pc[i])
                    roots = np.unique(label[at])
                    if len(roots) > 1:
                        label[np.isin(label, roots)] = roots[0]
                    links.append((p, int(h[at[0]])))
                if links:
                    a, b = zip(*links)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([0] * len(a), pa.int64())], names=["a", "b", "n"])
        if now is not None:
            yield close(h, label, counts)

    return tasks.mapInArrow(run, "a long, b long, n long")


def dedup(vectors: DataFrame, *, vec_id="vec_id", vector="embedding", threshold: float = 0.9, reach: float | None = None, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors.

    - unusable vectors (null, empty, zero, null or non-finite components): no links, kept
    - vectors of different lengths never link; repeated rows link with each other as equal vectors do
    - component_id: the smallest vec_id that links reach; kept where it is the row's own (so a null id is
      kept only where its component has no other)
    - reach: None for the usual one, by the vectors' length; 1 misses no link, at the cost of many more probes
    - very long vectors are like others; ties between centres: the first centre
    - empty table: empty result. Other columns are not read, whatever their names
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    keyed = rows.select("vec_id", "v", F.when(usable(F.col("v")), F.xxhash64("v")).alias("h"))
    distinct = materialize(keyed.filter("h is not null").groupBy("h").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("vec_id")))
    cells, n_cells = _indexed(distinct, threshold, reach, seed)
    cells = materialize(cells)
    sizes = cells.groupBy(F.col("own").alias("cell")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_nb"))
    coming = cells.select(F.explode("near").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("_np"))
    shape = materialize(sizes.join(coming, "cell"))
    if n_cells <= MAX_SENT:
        shape = F.broadcast(shape)
    block, probe = F.pmod("h", F.col("_nb")).cast("int"), F.pmod("h", F.col("_np")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["h", "v", "own", "copies"]
    stored = cells.withColumn("cell", F.col("own")).join(shape, "cell").select(*kept, "near", "cell", block.alias("_b"), each("_np").alias("_p"), F.lit(False).alias("probe"))
    probes = cells.withColumn("cell", F.explode("near")).join(shape, "cell").select(*kept, F.lit(None).cast("array<bigint>").alias("near"), "cell", probe.alias("_p"), each("_nb").alias("_b"), F.lit(True).alias("probe"))
    tasks = stored.unionByName(probes).withColumn("task", F.xxhash64("cell", "_b", "_p")).drop("cell", "_b", "_p")
    tasks = tasks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "task").sortWithinPartitions("task", "probe")
    found = materialize(_compared(tasks, threshold))
    counts = found.filter("b is null").groupBy(F.col("a").alias("h")).agg(F.sum("n").alias("_n"))
    roots = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "h")
    named = distinct.select("h", "vec_id", "copies").join(roots, "h", "left").join(counts, "h", "left")
    n_links = (F.coalesce("_n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    # Only vectors with links meet by root, and those of a large component over SALTS keys.
    salt = F.pmod(F.xxhash64("h"), F.lit(SALTS)).cast("int").alias("_salt")
    named = materialize(named.select("h", "vec_id", "root", n_links, salt))
    linked = named.filter("root is not null")
    least = linked.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    least = least.select("root", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    of = linked.join(least, ["root", "_salt"]).select("h", "n_links", "component_id")
    of = of.unionByName(named.filter("root is null").select("h", "n_links", F.col("vec_id").alias("component_id")))
    out = keyed.select("vec_id", "h").join(of, "h", "left")
    component = F.when(F.col("h").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
