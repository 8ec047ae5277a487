"""Exact n-gram Jaccard join with a prefix tree.

1. Every whole text becomes a set of word shingles in one global order: rarer by a table of counts
   first, then by hash. Equal sets become one node.
2. Two sets that reach the threshold share one of their first tokens, so each set is filed under those
   of its first tokens that another set has too. A token's hub is its least node, and all sets filed
   under a token are in the group of that hub.
3. Hubs are verified with their members first; that joins most copies into components.
4. In each group and range of sizes a prefix tree over the members' ordered lists finds the pairs of different components
   that may still link (`trie.candidates`). A large group is split in blocks that meet pairwise, each meeting being
   a cell for one task; of its largest component, the blocks meet those of the other members and not each other.
   What leaves a task is not the pairs but the members that have one.
5. These members' whole texts are sent to the same tasks, which walk the tree again and verify each pair
   whose ends are still apart. A task writes fewer links than it has members.

Pairs inside a component already found are not compared again: they cannot change it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trie
from .common import discard, in_memory, materialize
from .components import components
from .shingles import HEAT_BITS, mix, ordered, shingles

#: Members of a group that one task compares with as many others.
BLOCK = 1024
#: Parts that the nodes of one component are dealt over where they meet their component's least id.
SALTS = 16
#: Pairs of members that a task looks at together.
PAIRS = 1_000_000
#: Bits of the map that keeps texts no candidate needs out of the shuffle; a full map only stops saving.
MAP_BITS = 1 << 22


def row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("string"), F.lit("|"), F.col(text))


def _heat(docs: DataFrame, width: int) -> np.ndarray:
    """Level 0 to 7 of each of 2**HEAT_BITS cells of shingle hashes, from counts over all documents. A
    task leaves out the cells that it saw six times at most, or twice as often as its mean cell: a shingle
    common enough to have a level is above that in some tasks. Levels only set the order of tokens, so they
    decide how much is compared and never what links."""
    cells = 1 << HEAT_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(cells, np.int32), 0
        for b in batches:
            for _, g in shingles(b.column(0).to_pylist(), width):
                at = (g >> np.uint64(64 - HEAT_BITS)).astype(np.int64)
                if len(at) >= 256:  # within a text a shingle counts once, near enough
                    at = np.unique(at)
                np.add.at(total, at, 1)
                seen += len(at)
        at = np.flatnonzero(total > max(6, 2 * seen / cells))
        yield pa.RecordBatch.from_pydict({"cell": np.append(at, -1).astype(np.int32), "n": np.append(total[at].astype(np.int64), seen)})

    sums = docs.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = sums.column("cell").to_numpy(), sums.column("n").to_numpy()
    limit = max(8.0, 2 * n[cell < 0].sum() / cells)
    heat = np.zeros(cells, np.uint8)
    hot = (cell >= 0) & (n > limit)
    heat[cell[hot]] = np.minimum(7, 1 + np.log2(n[hot] / limit)).astype(np.uint8)
    return heat


def _sets(rows: DataFrame, heat: Broadcast, width: int, percent: int) -> DataFrame:
    """rows: doc_id, rk, text. Per row: doc_id, rk, n (set size), node (from the whole set; null without
    words), first (the first tokens in order)."""
    schema = pa.schema([("rk", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("first", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns, nodes, firsts = [], [], []
            for _, g in shingles(b.column("text").to_pylist(), width):
                key = ordered(g, heat.value)
                n = len(key)
                ns.append(n)
                nodes.append(int((mix(key).sum() ^ np.uint64(n)).astype(np.int64)) if n else None)
                firsts.append(key[: n + percent * -n // 100 + 1 if n else 0].astype(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in firsts]))).astype(np.int32)
            first = pa.ListArray.from_arrays(offsets, np.concatenate(firsts) if firsts else np.empty(0, np.int64))
            out = {"rk": b.column("rk"), "n": pa.array(ns, pa.int64()), "node": pa.array(nodes, pa.int64()), "first": first}
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *out.values()], schema=pa.schema([("doc_id", b.schema.field("doc_id").type), *schema]))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, rk long, n long, node long, first array<long>")


def with_keys(rows: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """rows whose `column` may be in `keys` (a superset), and the others, told apart without a shuffle by
    a bit map of fixed size."""
    bits = keys.select(F.pmod(F.col(column), F.lit(MAP_BITS)).cast("int").alias("bit")).distinct().toArrow().column("bit").to_numpy()
    table = np.zeros(MAP_BITS, bool)
    table[bits] = True
    given = rows.sparkSession.sparkContext.broadcast(np.packbits(table))

    def keep(wanted: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b.column(column).to_numpy(zero_copy_only=False) % MAP_BITS
                hit = (given.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
                yield b.filter(pa.array(hit == wanted))

        return rows.mapInArrow(run, rows.schema)

    return keep(True), keep(False)


def _with_texts(rows: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows (cell, node and more) with the text of each node, by cell. Texts are shuffled twice: to the rows that
    want them, by row key, and with these to their cells."""
    need = materialize(rows.join(nodes.select("node", "rk"), "node"))
    found, _ = with_keys(docs.select("rk", "text"), need, "rk")
    once = found.groupBy("rk").agg(F.first("text").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return once.join(in_memory(need), "rk").drop("rk").repartition(parts, "cell")


def _hopeful(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their known tokens do not rule out: up to the lesser of their last known
    tokens, what one set has and the other lacks must stay within what the threshold allows."""
    side = lambda x: lists.select(*[F.col(c).alias(f"{c}_{x}") for c in lists.columns]).withColumnRenamed(f"node_{x}", x)
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            n, plen, last = ([t.column(f"{c}_{x}").to_numpy() for x in "ab"] for c in ("n", "plen", "last"))
            off, token, place = ([], [], [])
            for x in "ab":
                tokens, places = t.column(f"tokens_{x}"), t.column(f"places_{x}")
                off.append(tokens.offsets.to_numpy())
                token.append(tokens.values.to_numpy())
                place.append(places.values.to_numpy())
            allowed = trie.slack(n[0] + n[1], percent)
            keep = np.zeros(t.num_rows, bool)
            for k in range(t.num_rows):
                lo, hi = zip(*[(o[k], o[k + 1]) for o in off])
                mine = [token[s][lo[s] : hi[s]] for s in (0, 1)]
                cut = min(last[0][k], last[1][k])
                below = []
                for s in (0, 1):
                    q = int(np.searchsorted(mine[s], cut, "right"))
                    below.append(plen[s][k] if last[s][k] == cut else place[s][lo[s] + q - 1] + 1 if q else 0)
                keep[k] = below[0] + below[1] - 2 * len(np.intersect1d(*mine, assume_unique=True)) <= allowed[k]
            yield t.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def _stars(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole texts reach the threshold. Each a meets its partners in cells of about
    BLOCK of them at most."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("_nb"))
    placed = pairs.join(blocks, "a").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("_nb"))).alias("cell"))
    rows = placed.select("cell", F.col("a").alias("node"), F.lit(0).alias("turn")).distinct().unionByName(placed.select("cell", F.col("b").alias("node"), F.lit(1).alias("turn")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, mine, cell = None, None, None
        for b in batches:
            cells, turn, node = (b.column(c).to_pylist() for c in ("cell", "turn", "node"))
            out = []
            for k, grams in shingles(b.column("text").to_pylist(), width):
                keys = ordered(grams, None)
                if not turn[k]:
                    hub, mine, cell = node[k], keys, cells[k]
                    continue
                if cells[k] != cell:
                    raise ValueError("a cell without its first node")
                inter = len(np.intersect1d(mine, keys, assume_unique=True))
                if 100 * inter >= percent * (len(mine) + len(keys) - inter):
                    out.append((hub, node[k]))
            x, y = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_pydict({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    return _with_texts(rows, docs, nodes).select("cell", "turn", "node", "text").sortWithinPartitions("cell", "turn").mapInArrow(run, "a long, b long")


def _walk(cell: np.ndarray, size: np.ndarray, plen: np.ndarray, last: np.ndarray, side: np.ndarray, lists: list, places: list, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of a run of cells, some cells at a time so that their pairs fit in memory."""
    edges = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]))
    at = 0
    while at < len(edges) - 1:
        to, pairs = at, 0
        while to < len(edges) - 1 and (to == at or pairs + (edges[to + 1] - edges[to]) ** 2 <= PAIRS):
            pairs += (edges[to + 1] - edges[to]) ** 2
            to += 1
        lo, hi = edges[at], edges[to]
        i, j = trie.candidates(cell[lo:hi], size[lo:hi], plen[lo:hi], last[lo:hi], side[lo:hi], lists[lo:hi], places[lo:hi], percent)
        yield i + lo, j + lo
        at = to


def _whole_cells(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches sorted by `cell`, put together to tables of whole cells with about `rows` rows or more."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= rows:
            cells = b.column("cell").to_numpy()
            cut = np.flatnonzero(cells[1:] != cells[:-1])
            if len(cut):
                cut = int(cut[-1]) + 1
                yield pa.Table.from_batches([*held[:-1], b.slice(0, cut)]).combine_chunks()
                held, n = [b.slice(cut)], b.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _near(members: DataFrame, percent: int) -> DataFrame:
    """members: cell, node, n, plen, last, side, tokens and their places, by cell. The (cell, node)
    that have a candidate of another side in their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_cells(batches, 4096):
            col = {c: t.column(c).to_numpy() for c in ("cell", "node", "n", "plen", "last", "side")}
            tokens, places = (t.column(c).combine_chunks() for c in ("tokens", "places"))
            off = tokens.offsets.to_numpy()
            token, place = tokens.values.to_numpy(), places.values.to_numpy().astype(np.int64)
            cut = [slice(a, b) for a, b in zip(off[:-1], off[1:])]
            hit = np.zeros(t.num_rows, bool)
            for i, j in _walk(*(col[c] for c in ("cell", "n", "plen", "last", "side")), [token[s] for s in cut], [place[s] for s in cut], percent):
                hit[i] = hit[j] = True
            yield pa.RecordBatch.from_pydict({"cell": col["cell"][hit], "node": col["node"][hit]})

    return members.select("cell", "node", "n", "plen", "last", "side", "tokens", "places").mapInArrow(run, "cell long, node long")


def _linked(members: DataFrame, heat: Broadcast, width: int, percent: int, every: bool = False) -> DataFrame:
    """members: cell, node, comp, side, text, by cell. Links (a, b) enough to join what links across the sides of a cell, or
    all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_cells(batches, 512):
            cell, node, comp, side = (t.column(c).to_numpy() for c in ("cell", "node", "comp", "side"))
            whole = [ordered(g, heat.value).astype(np.int64) for _, g in shingles(t.column("text").to_pylist(), width)]
            size = np.array([len(w) for w in whole], np.int64)
            plen = size + percent * -size // 100 + 1
            known = [w[:k] for w, k in zip(whole, plen)]
            found, back, times = np.unique(np.concatenate(known), return_inverse=True, return_counts=True)
            place = np.concatenate([np.arange(k) for k in plen])
            twice = np.split(times[back] > 1, np.cumsum(plen)[:-1])
            spots = np.split(place, np.cumsum(plen)[:-1])
            lists, spots = [k[m] for k, m in zip(known, twice)], [x[m] for x, m in zip(spots, twice)]
            last = np.array([k[-1] for k in known])
            out = []
            for i, j in _walk(cell, size, plen, last, side, lists, spots, percent):
                up: dict[tuple, tuple] = {}

                def root(x: tuple) -> tuple:
                    while x in up:
                        if up[x] in up:
                            up[x] = up[up[x]]
                        x = up[x]
                    return x

                for x, y in zip(i.tolist(), j.tolist()):
                    a, b = root((cell[x], comp[x])), root((cell[y], comp[y]))
                    if a != b:
                        inter = len(np.intersect1d(whole[x], whole[y], assume_unique=True))
                        if 100 * inter >= percent * (size[x] + size[y] - inter):
                            if not every:
                                up[a] = b
                            out.append((node[x], node[y]))
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return members.select("cell", "node", "comp", "side", "text").mapInArrow(run, "a long, b long")


def _meetings(members: DataFrame) -> DataFrame:
    """members: hub, _k, node, comp, _own. cell, node, comp and side for every cell that a member is in: pairs of one
    side need no comparison there. Groups of one component, or without a member of their own bucket, are done.

    A group of R members beside its largest component of D has R * (R + D) / BLOCK members in its cells, not (R + D) ** 2 / BLOCK."""
    each = members.groupBy("hub", "_k", "comp").agg(F.count("*").alias("_n"), F.max("_own").alias("_top"))
    found = each.groupBy("hub", "_k").agg(F.sum("_n").alias("_m"), F.max("_n").alias("_d"), F.max_by("comp", F.struct("_n", "comp")).alias("_dom"), F.count("*").alias("_comps"), F.max("_top").alias("_top"))
    found = found.filter("_comps > 1 and _top = _k")
    apart = (F.col("_m") > BLOCK) & (2 * F.col("_d") >= F.col("_m"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    found = found.select("hub", "_k", F.when(apart, F.col("_dom")).alias("_dom"), blocks(F.when(apart, F.col("_m") - F.col("_d")).otherwise(F.col("_m"))).alias("_nr"), blocks(F.when(apart, F.col("_d")).otherwise(0)).alias("_nd"))
    rows = members.join(found, ["hub", "_k"])
    inside = F.coalesce(F.col("comp") == F.col("_dom"), F.lit(False))
    rows = rows.withColumn("_in", inside).withColumn("_b", F.pmod(F.xxhash64("node"), F.when(F.col("_in"), F.col("_nd")).otherwise(F.col("_nr"))).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda kind, x, y, side: F.struct(F.xxhash64("hub", "_k", F.lit(kind), x, y).alias("cell"), side.cast("bigint").alias("side"))
    among = F.transform(upto(F.col("_nr")), lambda j: cell(0, F.least(F.col("_b"), j), F.greatest(F.col("_b"), j), F.col("comp")))
    across = F.transform(upto(F.col("_nd")), lambda j: cell(1, F.col("_b"), j, F.lit(0)))
    back = F.transform(upto(F.col("_nr")), lambda j: cell(1, j, F.col("_b"), F.lit(1)))
    return rows.select("node", "comp", F.explode(F.when(F.col("_in"), back).otherwise(F.concat(among, across))).alias("_c")).select("_c.cell", "node", "comp", "_c.side")


def _named(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """node, root and component_id of every node. Only nodes with links are joined by root; a large component is dealt over SALTS keys."""
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("_salt")
    linked = roots.join(nodes.select("node", "doc_id"), "node").select("node", "root", "doc_id", salt)
    least = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    least = least.select("root", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    found = linked.join(least, ["root", "_salt"]).select("node", "root", "component_id")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return nodes.select("node", "doc_id").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"), component)


@dataclass(frozen=True)
class _Index:
    """What steps 1 and 2 give. rows: doc_id, rk, text. sets: doc_id, rk, n, node. nodes: node, rk, n, doc_id, plen, last.
    group: hub, node. lists: node, n, plen, last, and the shared ones of its first tokens with their places."""

    rows: DataFrame
    heat: Broadcast
    sets: DataFrame
    nodes: DataFrame
    group: DataFrame
    lists: DataFrame
    width: int
    percent: int


def _index(docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> _Index:
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("rk"), F.col(text).alias("text"))
    heat = docs.sparkSession.sparkContext.broadcast(_heat(rows.select("text"), width))
    sets = materialize(_sets(rows, heat, width, percent))
    alike = [F.min("rk").alias("rk"), F.first("n").alias("n"), F.min("doc_id").alias("doc_id"), F.first("first").alias("first")]
    nodes = sets.filter("node is not null").groupBy("node").agg(*alike)
    nodes = materialize(nodes.withColumns({"plen": F.size("first"), "last": F.element_at("first", -1)}))
    # Two sets that link share a token within the least of each, and within the fewer least tokens of the
    # smaller that a partner of its own size would ask for (its index part).
    part = F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / F.lit(100 + percent)) + 1
    filed = nodes.select("node", part.alias("_part"), F.posexplode("first").alias("place", "token"))
    hub = F.min(F.when(F.col("place") < F.col("_part"), F.col("node"))).alias("hub")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hubs = filed.groupBy("token").agg(hub, F.min("node").alias("_least"), F.max("node").alias("_most"))
    hubs = materialize(hubs.filter("_least < _most").select("token", "hub"))
    shared = materialize(filed.drop("_part").join(in_memory(hubs, parts), "token").select("token", "node", "place", "hub"))
    group = materialize(shared.filter("hub is not null").select("hub", "node").distinct())
    lists = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("token", "place"))).alias("_l"))
    lists = lists.select("node", F.col("_l.token").alias("tokens"), F.col("_l.place").alias("places"))
    lists = materialize(lists.join(nodes.select("node", "n", "plen", "last"), "node"))
    discard(hubs, shared)
    return _Index(rows, heat, sets, nodes, group, lists, width, percent)


def _hub_links(x: _Index) -> DataFrame:
    """Links (a, b) of hubs with members of their groups."""
    size = x.nodes.select("node", "n")
    near = x.group.filter("hub <> node").join(size, "node").join(size.select(F.col("node").alias("hub"), F.col("n").alias("_hn")), "hub")
    near = near.filter(F.lit(100) * F.least("n", "_hn") >= F.lit(x.percent) * F.greatest("n", "_hn"))
    near = materialize(_hopeful(near.select(F.col("hub").alias("a"), F.col("node").alias("b")), x.lists, x.percent))
    links = materialize(_stars(near, x.rows, x.nodes, x.width, x.percent))
    discard(near)
    return links


def _group_links(x: _Index, roots: DataFrame | None) -> DataFrame:
    """Links (a, b) between nodes of different roots, enough to join what links; without roots all links, some twice."""
    known = x.group.join(x.nodes.select("node", "n"), "node")
    comp = F.col("node") if roots is None else F.coalesce("root", "node")
    # Sizes that can match are of the same bucket or of neighbours: cell (hub, k) has buckets k - 1 and k.
    bucket = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / x.percent) * (1 + 1e-9))).cast("int")
    members = known if roots is None else known.join(roots, "node", "left")
    members = members.select("hub", "node", comp.alias("comp"), bucket.alias("_own"))
    members = materialize(members.select("*", F.explode(F.array("_own", F.col("_own") + 1)).alias("_k")))
    cells = materialize(_meetings(members))
    parts = int(x.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    close = materialize(_near(cells.join(x.lists, "node").repartition(parts, "cell").sortWithinPartitions("cell"), x.percent))
    # Of a cell's members only those with a candidate there are compared by their whole texts.
    again = _with_texts(cells.join(close, ["cell", "node"]), x.rows, x.nodes).sortWithinPartitions("cell")
    links = materialize(_linked(again, x.heat, x.width, x.percent, roots is None))
    discard(members, cells, close)
    return links


def join(docs: DataFrame, *, doc_id="doc_id", text="text", width: int = 4, percent: int = 85, with_root: bool = False) -> DataFrame:
    """doc_id, rk (a hash of id and text), n_shingles, component_id for every row of docs; with_root adds
    root, the component's least node, which tells components apart whatever their ids (null without words).

    Words are runs other than space and \\t..\\r, with A-Z in lower case. Sets of `width`-word shingles
    link when 100 * intersection >= percent * union.
    - fewer words than `width`: the whole sequence is the one shingle
    - null or empty text, or no words: no shingles, linked with nothing
    - component_id: the smallest doc_id that links reach, the row's own included; null ids link as
      others do but are never the smallest unless the whole component has none
    - repeated rows and ids: each row is there once, with the same values. Very long texts are compared whole
    - ties cannot occur: the order of tokens is total. Empty table: empty result. Other columns are not read.
    """
    x = _index(docs, doc_id, text, width, percent)
    links = _hub_links(x)
    roots = components(links)
    more = _group_links(x, roots)
    discard(x.group, x.lists)
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    of_node = _named(x.nodes, roots).select("node", "component_id", *(["root"] if with_root else []))
    out = x.sets.select("doc_id", "rk", F.col("n").alias("n_shingles"), "node").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return out.select("doc_id", "rk", "n_shingles", component, *(["root"] if with_root else []))


def links(docs: DataFrame, *, doc_id="doc_id", text="text", width: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """All links, as (pairs, membership): pairs a < b of nodes, which stand for one set of shingles each, and doc_id,
    rk, n_shingles, node and n_links (other rows linked directly, those of equal sets included) of every row of docs.

    As many pairs as there are links between different sets; rows of equal sets make none. Odd rows are treated as in
    `join`: node is null and n_links 0 for a row without words."""
    x = _index(docs, doc_id, text, width, percent)
    found = _group_links(x, None)
    pairs = materialize(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    discard(x.group, x.lists, found)
    copies = x.sets.filter("node is not null").groupBy("node").agg(F.count("*").alias("_n"))
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("_other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("_other")))
    others = ends.join(copies.select(F.col("node").alias("_other"), F.col("_n").alias("_m")), "_other").groupBy("node").agg(F.sum("_m").alias("_m"))
    counts = copies.join(others, "node", "left").select("node", (F.col("_n") - 1 + F.coalesce("_m", F.lit(0))).alias("n_links"))
    rows = x.sets.join(counts, "node", "left")
    return pairs, rows.select("doc_id", "rk", F.col("n").alias("n_shingles"), "node", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def keep_first(docs: DataFrame, *, doc_id="doc_id", text="text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group that links join: the one of the least doc_id (null last; then of the least
    rk), and one of equal rows. Rows without words stay. Which rows go is told from ids and hashes, and only texts
    that may go are shuffled."""
    found = materialize(join(docs, doc_id=doc_id, text=text, width=width, percent=percent, with_root=True))
    worded = found.filter("n_shingles > 0")
    # Ids may repeat or be null, so a group is told by its root and a row by its hash.
    first = worded.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_last"), "doc_id", "rk")).alias("_k")).select(F.col("_k.rk").alias("rk"), F.lit(True).alias("_kept"))
    extra = worded.groupBy("rk").agg(F.count("*").alias("_n"))
    judged = extra.join(first, "rk", "left").withColumn("_one", F.coalesce("_kept", F.lit(False)))
    judged = materialize(judged.filter("_n > 1 or not _one").select(F.col("rk").alias("_rk"), "_one"))
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(c) for c in columns]).alias("_row"), row_key(doc_id, text).alias("_rk"))
    maybe, sure = with_keys(rows, judged, "_rk")
    again = maybe.join(judged, "_rk", "left")
    single = again.filter("_one").groupBy("_rk").agg(F.first("_row").alias("_row"))
    return sure.select("_row.*").unionByName(again.filter("_one is null").select("_row.*")).unionByName(single.select("_row.*"))
