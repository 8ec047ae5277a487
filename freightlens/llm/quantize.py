"""Vector codes: product quantization whose codebooks are fitted by Lloyd's rounds with Yinyang bounds.

Components become integers and vectors are cut into equal parts; each part position has a codebook of its own. The
entries of a codebook are clustered into groups once. A part keeps its entry, an upper bound of the distance to it
and, for each group, one lower bound of the distances to the group's other entries. After a round the upper bound grows
by what the entry moved and a group's lower bound falls by what its entries moved at most. Where no lower bound
reaches below the upper one the entry stays and nothing is computed; else the upper bound is made exact, and only the groups
whose bound still fails are scanned. What floats cannot tell apart is compared in integers, and ties go to the lower index.

A round is one pass of tasks that write their rows' codes and bounds, and for each entry one sum and count of the
parts they gave it; the codebooks, of fixed size, are all that comes to the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize

#: Entries of a group of a codebook, about.
PER_GROUP = 10
#: Vectors that are worked on together.
TOGETHER = 4096
#: What bounds are widened by, since they are kept in single precision.
SLACK = 2.0**-20
#: Labels with more than one of so many rows are joined by broadcast; so there are fewer of them than this.
HEAVY = 1000


def finite(v: Column) -> Column:
    """False for null vectors and those with a component that is null or not finite."""
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def groups_of(entries: np.ndarray) -> np.ndarray:
    """A group for each entry of a codebook: some Lloyd rounds from evenly chosen entries."""
    n = max(1, len(entries) // PER_GROUP)
    x = entries.astype(np.float64)
    c = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(5):
        to = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[to == g].mean(axis=0) if (to == g).any() else c[g] for g in range(n)])
    return ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)


@dataclass(frozen=True)
class Codebooks:
    """entries: part x entry x component; group: of each part and entry; drift: what each entry moved since the round
    before, or None in the first."""

    entries: np.ndarray
    group: np.ndarray
    drift: np.ndarray | None = None

    @property
    def n_groups(self) -> int:
        return int(self.group.max(initial=0)) + 1

    def moved(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """After a round, by each entry's count and sums; an entry without parts stays."""
        new = self.entries.copy()
        for (p, k), (n, s) in sums.items():
            new[p, k] = [x // n for x in s]
        return Codebooks(new, self.group, np.sqrt(((new - self.entries).astype(np.float64) ** 2).sum(axis=2)))

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c in floats."""
    x, c = x.astype(np.float64), c.astype(np.float64)
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1), 0)


def off_by(x: np.ndarray, c: np.ndarray) -> float:
    """How far the squared distances of x to c may be off: 0 where all steps are exact."""
    most = float(np.abs(x).max(initial=0)) + float(np.abs(c).max(initial=0))
    return 0.0 if 4 * x.shape[1] * most**2 < 2**52 else 2.0**-49 * (x.shape[1] + 4) * most**2


def least(x: np.ndarray, c: np.ndarray, d: np.ndarray, off: float) -> np.ndarray:
    """Nearest entry of each row by its squared distances d; those that may tie are compared in integers."""
    rows = np.arange(len(x))
    best = d.argmin(axis=1)
    close = d <= d[rows, best][:, None] + 2 * off
    some = np.flatnonzero(close.sum(axis=1) > 1)
    if len(some):
        r, k = np.nonzero(close[some])
        exact = ((x[some[r]] - c[k]) ** 2).sum(axis=1)
        order = np.lexsort((k, exact, r))
        first = np.concatenate(([True], np.diff(r[order]) > 0))
        best[some] = k[order][first]
    return best


def scan(x: np.ndarray, c: np.ndarray, group: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, upper bound and lower bounds by group of each row of x, from all distances."""
    d, off = squared(x, c), off_by(x, c)
    best = least(x, c, d, off)
    rows = np.arange(len(x))
    upper = np.sqrt(d[rows, best] + off) * (1 + SLACK)
    d[rows, best] = np.inf
    lower = np.stack([d[:, group == g].min(axis=1, initial=np.inf) for g in range(n_groups)], axis=1)
    return best, upper, np.sqrt(np.maximum(lower - off, 0)) * (1 - SLACK)


def rescan(x: np.ndarray, c: np.ndarray, group: np.ndarray, drift: np.ndarray, best: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after entries moved, from the bounds before, and how many distances were computed."""
    n_groups = lower.shape[1]
    by_group = np.array([drift[group == g].max(initial=0) for g in range(n_groups)])
    upper = (upper + drift[best]) * (1 + SLACK)
    lower = np.maximum(lower - by_group, 0) * (1 - SLACK)
    at = np.flatnonzero(lower.min(axis=1) <= upper)
    computed = len(at)
    if not computed:
        return best, upper, lower, 0
    some, off = x[at], off_by(x, c)
    own = ((some - c[best[at]]) ** 2).sum(axis=1)
    upper[at] = np.sqrt(own.astype(np.float64) + off) * (1 + SLACK)
    still = lower[at].min(axis=1) <= upper[at]
    at, some, own = at[still], some[still], own[still]
    rows, old = np.arange(len(at)), best[at]
    d = np.full((len(at), len(c)), np.inf)
    d[rows, old] = own
    need = lower[at] <= upper[at][:, None]
    for g in range(n_groups):
        r, k = np.flatnonzero(need[:, g]), np.flatnonzero(group == g)
        if len(r) and len(k):
            d[r[:, None], k] = squared(some[r], c[k])
            computed += len(r) * len(k)
    new = least(some, c, d, off)
    best, best_d = best.copy(), d[rows, new]
    best[at] = new
    upper[at] = np.sqrt(best_d + off) * (1 + SLACK)
    d[rows, new] = np.inf
    for g in range(n_groups):
        # A group that was not scanned keeps its bound, but for the entry that was left.
        seen = np.sqrt(np.maximum(d[:, group == g].min(axis=1, initial=np.inf) - off, 0)) * (1 - SLACK)
        lower[at, g] = np.where(need[:, g], seen, np.minimum(lower[at, g], seen))
    return best, upper, lower, computed


def _rows_of(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """A matrix from binary values of one size."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """A matrix of lists; shorter ones end in zeros."""
    size = np.array(pc.list_value_length(lists), np.int64)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < size[:, None]] = lists.flatten().to_numpy()
    return out


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= TOGETHER:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def code_type(entries: int) -> type:
    """One byte for a part's entry where that is enough, else two, the low one first."""
    return np.uint8 if entries <= 256 else np.uint16


STATE = "code binary, upper binary, lower binary"
SUMS = "part int, entry int, n long, sums array<long>, computed long"


def one_pass(rows: DataFrame, books: Codebooks, last: bool = False) -> DataFrame:
    """rows: key, x, and in later rounds code, upper and lower. Gives rows of key, x and the new three; in the last
    pass key, code and error; in the others also a row per entry and task with its parts' number and sums."""
    parts, entries, width = books.entries.shape
    given = rows.sparkSession.sparkContext.broadcast(books)
    fields = [rows.schema["key"], *([] if last else [rows.schema["x"]]), *T.StructType.fromDDL("code binary, error long" if last else f"{STATE}, {SUMS}").fields]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = given.value
        g, code_kind = b.n_groups, code_type(entries)
        sums, counts, computed = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), 0
        key_type = x_type = None
        for t in _gathered(batches):
            n = t.num_rows
            key_type, x_type = t.schema.field("key").type, t.schema.field("x").type
            x = _matrix(t.column("x").combine_chunks(), parts * width).reshape(n, parts, width)
            code, error = np.zeros((n, parts), code_kind), np.zeros(n, np.int64)
            upper, lower = np.zeros((n, parts), np.float32), np.zeros((n, parts, g), np.float32)
            if b.drift is not None:
                code[:] = _rows_of(t.column("code"), code_kind, parts)
                upper[:] = _rows_of(t.column("upper"), np.float32, parts)
                lower[:] = _rows_of(t.column("lower"), np.float32, parts * g).reshape(n, parts, g)
            for p in range(parts):
                c = b.entries[p]
                if b.drift is None:
                    best, upper[:, p], lower[:, p] = scan(x[:, p], c, b.group[p], g)
                    computed += n * entries
                else:
                    best, upper[:, p], lower[:, p], did = rescan(x[:, p], c, b.group[p], b.drift[p], code[:, p].astype(np.int64), upper[:, p].astype(np.float64), lower[:, p].astype(np.float64))
                    computed += did
                code[:, p] = best
                if last:
                    error += ((x[:, p] - c[best]) ** 2).sum(axis=1)
                else:
                    for i in range(width):
                        np.add.at(sums[p, :, i], best, x[:, p, i])
                    counts[p] += np.bincount(best, minlength=entries)
            codes = pa.array([r.tobytes() for r in code], pa.binary())
            if last:
                columns = [t.column("key").combine_chunks(), codes, pa.array(error)]
            else:
                bounds = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (upper, lower)]
                columns = [t.column("key").combine_chunks(), t.column("x").combine_chunks(), codes, *bounds, *(pa.nulls(n, k) for k in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        if x_type is None or last:
            return
        p, k = np.nonzero(counts)
        spent = np.zeros(len(p), np.int64)
        spent[0] = computed
        empty = [pa.nulls(len(p), kind) for kind in (key_type, x_type, pa.binary(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(p.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(counts[p, k]), pa.array(sums[p, k].tolist(), pa.list_(pa.int64())), pa.array(spent)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _first_entries(rows: DataFrame, vec_id: str, entries: int, parts: int, width: int) -> np.ndarray:
    """The parts of the rows of least id, nulls last, as part x entry x component."""
    least_ids = rows.orderBy(F.col(f"key.{vec_id}").asc_nulls_last(), "x").limit(entries).select("x").collect()
    x = np.zeros((len(least_ids), parts * width), np.int64)
    for i, r in enumerate(least_ids):
        x[i, : len(r.x)] = r.x
    return np.ascontiguousarray(x.reshape(len(x), parts, width).swapaxes(0, 1))


def integers(v: Column, scale: int, dims: int) -> Column:
    """floor(scale * x) of each component, held within what keeps all squared distances of `dims` below 2**62."""
    most = float(2 ** ((62 - math.ceil(math.log2(max(1, dims)))) // 2 - 1))
    return F.transform(v, lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), x.cast("double") * scale))).cast("int"))


@dataclass(frozen=True)
class Coded:
    """rows: key (a struct of the columns asked for), code (of `code_type`, in order of parts) and error;
    books: the final codebooks; computed: distances computed in each fitting round."""

    rows: DataFrame
    books: Codebooks
    computed: list[int]


def fit_and_code(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Coded:
    """Codes of all vectors and the codebooks after `rounds` rounds, with codebooks that start as the vectors of the
    `entries` least ids.

    - vectors that are null or hold a null or non-finite component go; zero and empty ones stay
    - vectors of different lengths: the shorter ones count as ended by zeros, and so does a length that `parts` does
      not divide. A component of 2**26 or more (by the length) after scaling counts as that bound
    - ties of distance go to the lower entry; rows of equal ids start in order of their components, null ids last; repeated rows
      each count and have equal codes; fewer vectors than entries: fewer entries
    - other columns are read only if they are named in `keep`, whatever their names; empty table: empty result"""
    key = F.struct(*[F.col(c) for c in dict.fromkeys((vec_id, *keep))])
    good = vectors.filter(finite(F.col(vector))).select(key.alias("key"), F.col(vector).alias("x"))
    dims = good.agg(F.max(F.size("x"))).first()[0] or 0
    width = max(1, math.ceil(dims / parts))
    rows = good.select("key", integers(F.col("x"), scale, parts * width).alias("x"))
    start = _first_entries(rows, vec_id, entries, parts, width)
    if not start.shape[1]:
        return Coded(rows.select("key", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("bigint").alias("error")), Codebooks(start, np.zeros((parts, 0), int)), [])
    books, computed, state = Codebooks(start, np.array([groups_of(c) for c in start])), [], rows
    for _ in range(rounds):
        done = materialize(one_pass(state, books))
        sums = done.filter("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"), F.sum("computed").alias("computed"))
        found = sums.collect()  # parts x entries rows at most
        computed.append(sum(r.computed for r in found))
        if state is not rows:
            discard(state)
        books, state = books.moved({(r.part, r.entry): (r.n, r.sums) for r in found}), done.filter("part is null")
    final = one_pass(state, books, last=True)
    return Coded(final, books, computed)


def with_group_sums(rows: DataFrame, by: Column, value: Column, name: str) -> DataFrame:
    """rows with the sum of value over the rows that are equal in `by`, nulls together; null where it needs more than 64
    bits. A value of `by` that many rows have is joined by broadcast, so no task gets all of its rows."""
    sums = materialize(rows.groupBy(by.alias("_by")).agg(F.try_sum(value).alias(name), F.count("*").alias("_n")))
    total = sums.agg(F.sum("_n")).first()[0] or 0
    heavy = F.broadcast(sums.filter(F.col("_n") * HEAVY > total).select(F.col("_by").alias("_heavy"), F.col(name).alias("_sum"), F.lit(True).alias("_found")))
    marked = rows.join(heavy, by.eqNullSafe(F.col("_heavy")), "left")
    done = marked.filter("_found").select(*rows.columns, F.col("_sum").alias(name))
    light = sums.filter(F.col("_n") * HEAVY <= total).select("_by", name)
    rest = marked.filter("_found is null").join(light, by.eqNullSafe(F.col("_by"))).select(*rows.columns, name)
    return done.unionByName(rest)
