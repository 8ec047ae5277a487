"""Fill-in-the-middle examples, cut by rank and select on packed boundary bits.

A text's units are its runs of A-Z and a-z and its other code points, one each. One bit per byte of UTF-8 says whether
a unit begins there; the bits are packed, and a directory holds the number of ones before each block of them. The
ones between a text's two ends are its number of units, and select turns the numbers of two units into places of
bytes. A second vector with a bit for each code point's first byte counts the characters of what was cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a block of the directory.
BLOCK = 64
#: Bytes of text that are turned into bits at once, a multiple of 8 * BLOCK.
SLICE = 1 << 20
#: Positions that are looked up at once; each takes a block of counts.
LOOKUPS = 1 << 15
#: What marks prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


class RankSelect:
    """Bits packed eight to a byte, first bit highest, with the ones before each block."""

    def __init__(self, packed: np.ndarray, n_bits: int):
        self.blocks, self.n_bits = packed.reshape(-1, BLOCK), n_bits
        ones = np.empty(len(self.blocks), np.int64)
        for a in range(0, len(ones), LOOKUPS):
            ones[a : a + LOOKUPS] = np.bitwise_count(self.blocks[a : a + LOOKUPS]).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)))

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Number of ones before each position."""
        return self._by_parts(self._rank, at)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the one that k others come before; the length of the vector where there is none."""
        return self._by_parts(self._select, k)

    @staticmethod
    def _by_parts(look, given: np.ndarray) -> np.ndarray:  # noqa: ANN001
        given = np.asarray(given, np.int64)
        return np.concatenate([np.empty(0, np.int64), *[look(given[a : a + LOOKUPS]) for a in range(0, len(given), LOOKUPS)]])

    def _rank(self, at: np.ndarray) -> np.ndarray:
        block, byte, bit = at // (8 * BLOCK), at // 8 % BLOCK, at % 8
        inside = block < len(self.blocks)
        rows = self.blocks[np.where(inside, block, 0)] if len(self.blocks) else np.zeros((len(at), BLOCK), np.uint8)
        whole = (np.bitwise_count(rows) * (np.arange(BLOCK) < byte[:, None])).sum(axis=1, dtype=np.int64)
        part = np.bitwise_count(rows[np.arange(len(at)), byte] & (0xFF00 >> bit).astype(np.uint8))
        return self.before[np.minimum(block, len(self.blocks))] + np.where(inside, whole + part, 0)

    def _select(self, k: np.ndarray) -> np.ndarray:
        out = np.full(len(k), self.n_bits, np.int64)
        there = np.flatnonzero(k < self.total)
        block = np.searchsorted(self.before, k[there], side="right") - 1
        rest = k[there] - self.before[block]
        rows = self.blocks[block]
        upto = np.cumsum(np.bitwise_count(rows), axis=1, dtype=np.int64)
        byte = (upto <= rest[:, None]).sum(axis=1)
        here = np.arange(len(there))
        rest -= np.where(byte > 0, upto[here, np.maximum(byte - 1, 0)], 0)
        bits = np.cumsum(np.unpackbits(rows[here, byte][:, None], axis=1), axis=1)
        out[there] = (block * BLOCK + byte) * 8 + (bits <= rest[:, None]).sum(axis=1)
        return out


def boundaries(data: np.ndarray, starts: np.ndarray) -> tuple[RankSelect, RankSelect]:
    """Of the bytes of several texts one after the other: where units begin, and where code points do.
    starts: where the texts that are not empty begin."""
    n = len(data)
    size = -(-n // (8 * BLOCK)) * BLOCK
    units, points = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
    last = False
    for a in range(0, n, SLICE):
        b = data[a : a + SLICE]
        point = (b & 0xC0) != 0x80
        letter = ((b | 32) - np.uint8(97)) < 26
        follows = np.concatenate(([last], letter[:-1])) & letter
        last = bool(letter[-1])
        unit = point & ~follows
        lo, hi = np.searchsorted(starts, (a, a + len(b)))
        unit[starts[lo:hi] - a] = True
        for bits, packed in ((unit, units), (point, points)):
            got = np.packbits(bits)
            packed[a // 8 : a // 8 + len(got)] = got
    return RankSelect(units, n), RankSelect(points, n)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts together, and where each begins (one more at the end)."""
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data else np.empty(0, np.uint8)
    return raw, off - off[0]


@dataclass(frozen=True)
class Rules:
    """How texts are dealt: of 100, those from `plain_from` on stay plain, those under `spm_below` become spm."""

    plain_from: int = 90
    spm_below: int = 20
    marks: tuple[str, str, str] = MARKS

    def __post_init__(self):
        firsts = {m[:1] for m in self.marks}
        if len(set(self.marks)) < 3 or "" in firsts or any(c in m[1:] for c in firsts for m in self.marks):
            raise ValueError("marks must differ, and the characters they begin with must occur nowhere else in them")


def draws(key: Column, seed: str = "1") -> list[Column]:
    """Four numbers under 2**32 from the digest of seed:key; a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def transform(docs: DataFrame, *, text: str = "text", key: str = "doc_id", seed: str = "1", rules: Rules = Rules()) -> DataFrame:
    """docs with n_units, form, output, prefix_chars and middle_chars (columns of these names are replaced).

    - null text: as the empty one, which stays plain; so does a text that holds one of the marks
    - n_units: of every text; prefix_chars and middle_chars: code points, null where the form is plain
    - the cuts depend on seed, key and number of units alone, so rows with equal keys and texts have equal output, and
      a null key is one key among others; equal cuts give an empty middle
    - very long texts: cut whole, with some bits of memory for each of their bytes
    - other columns stay; empty table: empty result"""
    added = ("n_units", "form", "output", "prefix_chars", "middle_chars")
    kept = docs.drop(*added)
    marks = [m.encode() for m in rules.marks]
    h1, h2, h3, h4 = draws(kept[key], seed)
    whole = F.coalesce(kept[text], F.lit(""))
    marked = F.lit(False)
    for m in rules.marks:
        marked = marked | F.contains(whole, F.lit(m))
    plain = (whole == "") | marked | (h3 % 100 >= rules.plain_from)
    form = F.when(plain, "plain").when(h4 % 100 < rules.spm_below, "spm").otherwise("psm")
    rows = kept.select(F.struct("*").alias("row"), whole.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = _bytes(b.column("text"))
            units, points = boundaries(raw, off[:-1][np.diff(off) > 0])
            first = units.rank(off)
            n = np.diff(first)
            a, c = (b.column(h).to_numpy() % (n + 1) for h in ("h1", "h2"))
            cut1, cut2 = units.select(first[:-1] + np.minimum(a, c)), units.select(first[:-1] + np.maximum(a, c))
            before = [points.rank(x) for x in (off[:-1], cut1, cut2)]
            forms = b.column("form").to_pylist()
            plain = np.array([f == "plain" for f in forms], bool)
            view, out = memoryview(raw), []
            for f, lo, x, y, hi in zip(forms, off[:-1], cut1, cut2, off[1:]):
                prefix, middle, suffix = view[lo:x], view[x:y], view[y:hi]
                parts = {"plain": (view[lo:hi],), "psm": (marks[0], prefix, marks[1], suffix, marks[2], middle), "spm": (marks[1], suffix, marks[0], prefix, marks[2], middle)}[f]
                out.append(b"".join(parts))
            columns = [pa.array(n), b.column("form"), pa.array(out, pa.string()), pa.array(before[1] - before[0], mask=plain), pa.array(before[2] - before[1], mask=plain)]
            yield pa.RecordBatch.from_arrays([b.column("row"), *columns], names=["row", *added])

    kinds = (T.LongType(), T.StringType(), T.StringType(), T.LongType(), T.LongType())
    schema = T.StructType([rows.schema["row"], *[T.StructField(c, k) for c, k in zip(added, kinds)]])
    return rows.mapInArrow(run, schema).select("row.*", *added)


def restored(output: Column, form: Column, rules: Rules = Rules()) -> Column:
    """The text from which `transform` made output; null for a null output."""
    p, s, m = rules.marks
    quote = lambda x: "\\Q" + x.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    psm = F.split(F.substr(output, F.lit(len(p) + 1)), f"{quote(s)}|{quote(m)}", -1)
    spm = F.split(F.substr(output, F.lit(len(s) + 1)), f"{quote(p)}|{quote(m)}", -1)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)
