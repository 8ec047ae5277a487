"""Declared keys and references, all checked together in one pass over each table.

Each row of a table is turned into one entry for each part that it plays: as a key's values, as a reference, or as what
others refer to. The entries of all tables meet in one aggregation by constraint and values. It adds up on the map side
first, so of values that repeat, hot ones too, each task sends one entry; a null takes part in no reference and no unique
key, but breaks a primary one. A key that has all the columns of its table is settled by a count of its own.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A column's name, or a fixed text that is part of the key.
Part = str | tuple[str]


@dataclass(frozen=True)
class Key:
    """The columns' values differ from row to row; those of a primary key are not null."""

    name: str
    table: str
    columns: tuple[Part, ...]
    primary: bool = False


@dataclass(frozen=True)
class Reference:
    """The columns' values, unless one is null, are those of the parent's columns in some row."""

    name: str
    table: str
    columns: tuple[Part, ...]
    parent: str
    parent_columns: tuple[Part, ...]


def _names(parts: Sequence[Part]) -> list[str]:
    return [p for p in parts if isinstance(p, str)]


def _values(parts: Sequence[Part]) -> Column:
    """The values as texts; a part given as a tuple stands for itself."""
    return F.array(*[F.lit(p[0]) if isinstance(p, tuple) else F.col(p).cast("string") for p in parts])


def _any_null(parts: Sequence[Part]) -> Column:
    return functools.reduce(lambda x, y: x | y, [F.col(p).isNull() for p in _names(parts)], F.lit(False))


def _fixed(c: Reference) -> list[int]:
    """The places of a reference where the child's or the parent's part is a text, so that the parents with
    this text alone are asked for."""
    return [k for k, (a, b) in enumerate(zip(c.columns, c.parent_columns)) if isinstance(a, tuple) and isinstance(b, str)]


def _entries(name: str, df: DataFrame, constraints: Sequence[Key | Reference]) -> DataFrame | None:
    """Entries of one table: i, v, child and parent, the rows that are a child or a parent with these values, and known,
    the bad rows of an entry whose constraint is settled within the table; it then has no values.

    Where one key takes all columns that are asked for, rows are counted by it first: that settles the key, moves no
    row of a table that was just made by grouping by these columns, and its other entries follow from the counts."""
    here = [(i, c, c.table == name, isinstance(c, Reference) and c.parent == name) for i, c in enumerate(constraints)]
    here = [x for x in here if x[2] or x[3]]
    if not here:
        return None
    used = {p for _, c, child, parent in here for p in (*(_names(c.columns) if child else ()), *(_names(c.parent_columns) if parent else ()))}
    whole = next((i for i, c, child, _ in here if child and isinstance(c, Key) and set(_names(c.columns)) == used), None)
    counted = df.groupBy(*sorted(used)).agg(F.count(F.lit(1)).alias("_n")) if whole is not None else df.select(*sorted(used), F.lit(1).cast("bigint").alias("_n"))
    n, zero, none = F.col("_n"), F.lit(0).cast("bigint"), F.lit(None)
    nothing = none.cast("array<string>")
    parts = []
    for i, c, child, parent in here:
        entry = lambda v, a, b, known: F.struct(F.lit(i).alias("i"), v.alias("v"), a.alias("child"), b.alias("parent"), known.cast("bigint").alias("known"))  # noqa: B023, E731
        if child and isinstance(c, Key):
            null = _any_null(c.columns)
            if i == whole:
                parts.append(entry(nothing, n, zero, F.when(null, n if c.primary else zero).otherwise(n - 1)))
            else:
                parts.append(entry(F.when(~null, _values(c.columns)), n, zero, F.when(null, n if c.primary else zero)))
        elif child:
            null, kept = _any_null(c.columns), [p for k, p in enumerate(c.columns) if k not in _fixed(c)]
            parts.append(entry(F.when(~null, _values(kept)), n, zero, F.when(null, zero)))
        if parent:
            fixed = functools.reduce(lambda x, y: x & y, [F.col(c.parent_columns[k]).cast("string") == c.columns[k][0] for k in _fixed(c)], ~_any_null(c.parent_columns))
            kept = [p for k, p in enumerate(c.parent_columns) if k not in _fixed(c)]
            parts.append(F.when(fixed, entry(_values(kept), zero, n, none)))
    return counted.select(F.explode(F.array(*parts)).alias("e")).filter("e is not null").select("e.*")


def check(tables: Mapping[str, DataFrame], constraints: Sequence[Key | Reference]) -> DataFrame:
    """For each constraint: constraint, kind, rows (of its table) and bad. Bad rows are those beyond the first of
    each key, those with a null in a primary key, and those whose reference leads nowhere. Tables without rows pass."""
    missing = {t for c in constraints for t in (c.table, *((c.parent,) if isinstance(c, Reference) else ()))} - set(tables)
    if missing:
        raise ValueError(f"no table named {', '.join(sorted(missing))}")
    each = [one for name, df in tables.items() if (one := _entries(name, df, constraints)) is not None]
    spark = next(iter(tables.values())).sparkSession
    kinds = [("primary" if c.primary else "unique") if isinstance(c, Key) else "reference" for c in constraints]
    listed = spark.createDataFrame([(i, c.name, k) for i, (c, k) in enumerate(zip(constraints, kinds))], "i int, constraint string, kind string")
    entries = functools.reduce(DataFrame.unionByName, each).groupBy("i", "v").agg(*[F.sum(c).alias(c) for c in ("child", "parent", "known")])
    entries = entries.join(F.broadcast(listed.select("i", "kind")), "i")  # one row a constraint
    open_ = F.when(F.col("kind") == "reference", F.when(F.col("parent") == 0, F.col("child")).otherwise(0)).otherwise(F.greatest(F.col("child") - 1, F.lit(0)))
    found = entries.groupBy("i").agg(F.sum("child").alias("rows"), F.sum(F.when(F.col("v").isNull(), F.col("known")).otherwise(open_)).alias("bad"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return listed.join(found, "i", "left").select("constraint", "kind", zero("rows"), zero("bad"))


ENDS = {"gf": ("generator", "facility"), "gt": ("generator", "transporter"), "tf": ("transporter", "facility")}


def graph_constraints() -> list[Key | Reference]:
    """The keys of a built graph: of nodes, streams, yearly and quarterly edges, top lists and steps."""
    node = ("node_type", "business_id")
    out: list[Key | Reference] = [
        Key("graph_node_pkey", "nodes", ("graph_node_id",), True), Key("uq_graph_node", "nodes", node),
        Key("graph_waste_stream_key", "streams", ("waste_stream_key",), True),
    ]
    for kind, ends in ENDS.items():
        out += [Key(f"uq_{kind}_year", f"years_{kind}", ("year", *ends)), Key(f"uq_{kind}_quarter", f"quarters_{kind}", ("year_quarter", *ends, "waste_stream_key"))]
        for table, span in ((f"years_{kind}", "year"), (f"quarters_{kind}", "quarter")):
            out += [Reference(f"{kind}_{span}_{end}_fkey", table, ((end.upper(),), end), "nodes", node) for end in ends]
        out.append(Reference(f"{kind}_quarter_stream_fkey", f"quarters_{kind}", ("waste_stream_key",), "streams", ("waste_stream_key",)))
    return out + [Key(f"top_{c}_pkey", f"top_{c}", (c,), True) for c in ("line_no", "facility", "generator", "transporter")]


def run_constraints() -> list[Key | Reference]:
    """The keys of the record of runs: one row a run, and one for each quarter and step, whose run is known."""
    return [
        Key("graph_build_run_pkey", "runs", ("run",), True), Key("graph_stage_status_pkey", "states", ("year_quarter",), True),
        Key("graph_build_step_pkey", "steps", ("run", "year_quarter", "step"), True), Reference("graph_build_step_run_id_fkey", "steps", ("run",), "runs", ("run",)),
    ]
