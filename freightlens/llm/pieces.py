"""SentencePiece encoding and decoding by unigram Viterbi over a double-array trie.

A text gets a blank in front and its blanks become the marker U+2581. Among all ways to cut it into
pieces the one with the greatest sum of log scores is taken; of equal ones, the one whose pieces begin
earliest. A character that no piece covers alone may be taken at a penalty and is written as byte
pieces. Decoding joins the pieces, turns markers to blanks, byte pieces to bytes, and drops the first blank.

No piece holds a marker after another character, nor a line break, so the best cut of a text is the
best cuts of its words put together; each distinct word is cut once per task. A text is read a section at a time, and
a very long word is searched in windows that hand on the scores of the places a piece can still reach.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
#: What an uncovered character costs beyond the worst piece.
PENALTY = 10.0
#: Distinct words a task remembers.
MEMORY = 150_000
#: Words cut together; the arrays of the search have several entries per byte of them.
TOGETHER = 20_000
#: Characters from which on a word is searched alone, in windows of so many bytes, and not remembered.
LONG, WINDOW = 2048, 1 << 15
#: Words, or characters of a text, that are handled at once.
SECTION = 1 << 17
_WORD = re.compile(rf" *[^ \n{MARK}]+| +|\n|{MARK}")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as UTF-8 with blanks for markers, their log scores, and the trie: a child of node s by
    byte c is t = base[s] + c if check[t] == s; value[t] is the piece that ends at t, or -1."""

    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first place that is free for all children of a node, at or after the place found for the last
    node with as many children."""
    size = 256 * (len(words) + 16)
    base, check, value, used = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32), np.zeros(size, bool)
    used[0] = True
    items = sorted(words)
    todo, hint, window = [(0, 0, len(items), 0)] if items else [], {}, 1024  # node, its words [lo, hi), depth
    while todo:
        node, lo, hi, depth = todo.pop()
        if len(items[lo]) == depth:
            value[node] = words[items[lo]]
            lo += 1
        kids, at = [], lo
        while at < hi:
            c, first = items[at][depth], at
            while at < hi and items[at][depth] == c:
                at += 1
            kids.append((c, first, at))
        if not kids:
            continue
        b = hint.get(len(kids), 1)
        while True:
            taken = used[b + kids[0][0] : b + kids[0][0] + window].copy()
            for c, _, _ in kids[1:]:
                taken |= used[b + c : b + c + window]
            k = int(np.argmin(taken))
            if not taken[k]:
                break
            b += window
        hint[len(kids)] = b = b + k
        base[node] = b
        for c, first, last in kids:
            used[b + c] = True
            check[b + c] = node
            todo.append((b + c, first, last, depth + 1))
    end = int(np.flatnonzero(used)[-1]) + 257
    return base[:end].copy(), check[:end].copy(), value[:end].copy()


def vocabulary(pieces: list[str], scores: list[float], byte_ids: list[int], skip: set[int] = frozenset()) -> Vocabulary:
    """From all pieces in order of id. skip: ids that text never becomes (control pieces)."""
    plain = [p.replace(MARK, " ").encode() for p in pieces]
    out = set(byte_ids) | set(skip)
    words = {p: i for i, p in reversed(list(enumerate(plain))) if i not in out and p}
    if any(b" " in p.lstrip(b" ") or b"\n" in p for p in words):
        raise ValueError("a piece holds a marker after another character, or a line break")
    if len(byte_ids) != 256 or not out <= set(range(len(pieces))):
        raise ValueError("byte fallback needs 256 byte pieces, and ids must be those of pieces")
    for value, i in enumerate(byte_ids):
        plain[i] = bytes([value])
    return Vocabulary(plain, np.array(scores, np.float64), np.array(byte_ids, np.int32), *double_array(words))


def from_model(path: str, zipf: bool = True) -> Vocabulary:
    """The vocabulary of a SentencePiece model file. zipf: log scores by Zipf's law from the order of
    the model's own scores, for models whose scores are merge ranks and not log probabilities."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    scores = np.array([sp.get_score(i) for i in range(n)])
    skip = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
    of_byte = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
    if zipf:
        rank = np.empty(n)
        rank[np.argsort(-scores, kind="stable")] = np.arange(1, n + 1)
        scores = -np.log(rank) - np.log(np.sum(1 / np.arange(1, n + 1)))
    return vocabulary([sp.id_to_piece(i) for i in range(n)], list(scores), [of_byte[f"<0x{b:02X}>"] for b in range(256)], skip)


def _edges(data: np.ndarray, at: np.ndarray, width: np.ndarray, limit: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and id of all pieces that begin at the places `at` and end by `limit`; a character of `width`
    bytes that is no piece alone is there with id -1."""
    froms, tos, ids = [], [], []
    alone = np.zeros(len(at), bool)
    live, state, pos = np.arange(len(at)), np.zeros(len(at), np.int64), at.copy()
    while len(live):
        nxt = v.base[state] + data[pos].astype(np.int64)
        ok = (nxt < len(v.check)) & (v.check[np.minimum(nxt, len(v.check) - 1)] == state) & (v.base[state] > 0)
        live, state, pos = live[ok], nxt[ok], pos[ok] + 1
        piece = v.value[state]
        hit = np.flatnonzero(piece >= 0)
        froms.append(at[live[hit]])
        tos.append(pos[hit])
        ids.append(piece[hit])
        alone[live[hit[pos[hit] - at[live[hit]] == width[live[hit]]]]] = True
        more = pos < limit[live]
        live, state, pos = live[more], state[more], pos[more]
    bare = np.flatnonzero(~alone)
    froms.append(at[bare])
    tos.append(at[bare] + width[bare])
    ids.append(np.full(len(bare), -1, np.int32))
    return np.concatenate(froms), np.concatenate(tos), np.concatenate(ids)


def _spelled(piece: np.ndarray, frm: np.ndarray, to: np.ndarray, data: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of chosen edges, with byte pieces for those of id -1, and their number for each edge."""
    count = np.where(piece >= 0, 1, to - frm)
    total = np.cumsum(count)
    out = np.repeat(piece, count)
    byte_at = np.repeat(frm, count) + np.arange(len(out)) - np.repeat(total - count, count)
    return np.where(out >= 0, out, v.byte_ids[data[byte_at]]).astype(np.int32) if len(out) else out.astype(np.int32), count


def viterbi_long(word: bytes, v: Vocabulary) -> np.ndarray:
    """Ids of one word, as `viterbi` gives them: a window of starts at a time, so that only the way back (eight
    bytes for each of the word's) grows with the word."""
    data, n, longest = np.frombuffer(word, np.uint8), len(word), max(4, *map(len, v.pieces))
    came, by = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int32)
    best, lo, poor = [0.0], 0, v.scores.min() - PENALTY
    while lo < n:
        hi = min(n, lo + WINDOW)
        while hi < n and data[hi] & 0xC0 == 0x80:
            hi += 1
        at = np.flatnonzero((data[lo:hi] & 0xC0) != 0x80) + lo
        frm, to, piece = _edges(data, at, np.diff(np.append(at, hi)), np.full(len(at), n), v)
        order = np.argsort(frm, kind="stable")
        frm, to, piece = frm[order], to[order], piece[order]
        best += [-np.inf] * (hi - lo + longest + 1 - len(best))
        back = [-1] * len(best)
        for k, (a, b, g) in enumerate(zip((frm - lo).tolist(), (to - lo).tolist(), np.where(piece >= 0, v.scores[piece], poor).tolist())):
            score = best[a] + g
            if score > best[b]:
                best[b], back[b] = score, k
        back = np.array(back)
        reached = np.flatnonzero(back >= 0)
        came[lo + reached], by[lo + reached] = frm[back[reached]], piece[back[reached]]
        best, lo = best[hi - lo :], hi
    ends, cur = array("i"), n
    while cur > 0:
        ends.append(cur)
        cur = int(came[cur])
    to, out = np.frombuffer(ends, np.int32)[::-1], []
    for a in range(0, len(to), SECTION):
        some = to[a : a + SECTION]
        out.append(_spelled(by[some], came[some].astype(np.int64), some.astype(np.int64), data, v)[0])
    return np.concatenate(out)


def viterbi(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words together, and where each word's begin (one more at the end)."""
    data = np.frombuffer(b"".join(words), np.uint8)
    lens = np.array([len(w) for w in words], np.int64)
    stop = np.cumsum(lens)
    start = stop - lens
    n = len(data)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    width = np.diff(np.append(at, n))  # bytes of each character; words end at characters' ends
    limit = np.repeat(stop, lens)[at] if n else at
    frm, to, piece = _edges(data, at, width, limit, v)
    gain = np.where(piece >= 0, v.scores[piece], v.scores.min() - PENALTY)
    word_start = np.repeat(start, lens) if n else start
    local = frm - word_start[frm] if len(frm) else frm
    order = np.argsort(local, kind="stable")
    frm, to, piece, gain, local = frm[order], to[order], piece[order], gain[order], local[order]
    # Words lie one after the other, each with its own place for its end: byte i of word k is place i + k.
    word_of = np.repeat(np.arange(len(words)), lens)
    best = np.full(n + len(words), -np.inf)
    back = np.full(n + len(words), -1, np.int64)
    best[start + np.arange(len(words))] = 0.0
    shift = word_of[frm] if len(frm) else frm
    a, b = frm + shift, to + shift
    cuts = np.flatnonzero(np.diff(local)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(local)]):
        score = best[a[lo:hi]] + gain[lo:hi]
        better = score > best[b[lo:hi]]
        to_ = b[lo:hi][better]
        best[to_] = score[better]
        back[to_] = np.flatnonzero(better) + lo
    ends = np.zeros(n + len(words), bool)
    cur = (stop + np.arange(len(words)))[lens > 0]
    first = (start + np.arange(len(words)))[lens > 0]
    while len(cur):
        ends[cur] = True
        cur = a[back[cur]]
        keep = cur > first
        cur, first = cur[keep], first[keep]
    edge = back[np.flatnonzero(ends)]
    chosen, frm, to = piece[edge], frm[edge], to[edge]
    out, count = _spelled(chosen, frm, to, data, v)
    per_word = np.bincount(word_of[frm], weights=count, minlength=len(words)).astype(np.int64) if len(frm) else np.zeros(len(words), np.int64)
    return out, np.concatenate(([0], np.cumsum(per_word)))


class Encoder:
    """Remembers words already cut. Literal markers in a text become byte pieces, so that they survive."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.known, self.ids, self.off = v, {}, np.empty(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, new: list[str]) -> None:
        ids, off = viterbi([b"" if w == MARK else w.encode() for w in new], self.v)
        self.known |= {w: len(self.known) + k for k, w in enumerate(new)}
        self.ids, self.off = np.concatenate([self.ids, ids]), np.concatenate([self.off, off[1:] + self.off[-1]])
        if MARK in new:
            self._marker(self.known[MARK])

    def _marker(self, k: int) -> None:
        at = self.off[k]
        self.ids = np.concatenate([self.ids[:at], self.v.byte_ids[list(MARK.encode())], self.ids[at:]])
        self.off[k + 1 :] += len(MARK.encode())

    def _cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words together, and their number for each."""
        distinct = set(words)
        vast = {w for w in distinct.difference(self.known) if len(w) > LONG}
        long = [i for i, w in enumerate(words) if w in vast] if vast else []
        distinct -= vast
        if new := sorted(distinct.difference(self.known)):
            if len(self.known) + len(new) > MEMORY:
                new = sorted(distinct)
                self.known, self.ids, self.off = {}, np.empty(0, np.int32), np.zeros(1, np.int64)
            for k in range(0, len(new), TOGETHER):
                self._learn(new[k : k + TOGETHER])
        out, counts, at = [], [], 0
        for i in [*long, len(words)]:
            k = np.fromiter(map(self.known.__getitem__, words[at:i]), np.int64, i - at)
            first, count = self.off[k], self.off[k + 1] - self.off[k]
            total = np.cumsum(count)
            out.append(self.ids[np.repeat(first - (total - count), count) + np.arange(total[-1] if len(total) else 0)])
            counts.append(count)
            if i < len(words):
                out.append(viterbi_long(words[i].encode("utf-8", "surrogatepass"), self.v))
                counts.append([len(out[-1])])
            at = i + 1
        return np.concatenate(out), np.concatenate(counts)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts together, and where each text's begin (one more at the end)."""
        out, per_text = [np.empty(0, np.int32)], np.zeros(len(texts), np.int64)
        for words, owner in _sections(texts):
            ids, count = self._cut(words)
            out.append(ids)
            per_text += np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)
        return np.concatenate(out), np.concatenate(([0], np.cumsum(per_text)))


def _sections(texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray]]:
    """The words of all texts in order, some at a time, and the text of each."""
    words, owner = [], []
    for i, t in enumerate(texts):
        if not t:
            continue
        found = _WORD.finditer(" " + t) if len(t) > SECTION else None
        while new := [m[0] for m in islice(found, SECTION)] if found else _WORD.findall(" " + t):
            words += new
            owner.append((i, len(new)))
            if len(words) >= SECTION:
                yield words, np.repeat(*map(np.array, zip(*owner)))
                words, owner = [], []
            if found is None:
                break
    if words:
        yield words, np.repeat(*map(np.array, zip(*owner)))


def decode_ids(ids: np.ndarray, off: np.ndarray, v: Vocabulary) -> list[str]:
    """Texts of id lists; an incomplete byte sequence becomes U+FFFD."""
    lens = np.array([len(p) for p in v.pieces], np.int64)
    store, starts = np.frombuffer(b"".join(v.pieces), np.uint8), np.cumsum(lens) - lens
    parts = []
    for a in range(0, len(ids), SECTION):
        some = ids[a : a + SECTION]
        count = lens[some]
        total = np.cumsum(count)
        parts.append(store[np.repeat(starts[some] - (total - count), count) + np.arange(total[-1])].tobytes())
    raw = b"".join(parts)
    ends = np.concatenate(([0], np.cumsum(lens[ids])))[off]
    return [raw[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(ends[:-1], ends[1:])]


def encode(docs: DataFrame, v: Vocabulary, *, text: str = "text", out: str = "token_ids") -> DataFrame:
    """docs with the ids of each whole text (a column named `out` is replaced).

    - null or empty text: no ids. Equal texts, so also repeated rows and ids, give equal ids
    - ties between cuts: the one whose last piece begins earliest, and so on backwards
    - very long texts and words: encoded whole, with memory of some bytes for each of the text's
    - extra columns stay; empty table: empty result"""
    docs = docs.drop(out)
    given = docs.sparkSession.sparkContext.broadcast(v)
    names = [*docs.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(given.value)
        for b in batches:
            ids, off = encoder.encode(b.column(text).to_pylist())
            column = pa.ListArray.from_arrays(off.astype(np.int32), ids)
            yield pa.RecordBatch.from_arrays([*b.columns, column], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, v: Vocabulary, *, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """rows with the text of each id list (a column named `out` is replaced). Null: the empty text."""
    rows = rows.drop(out)
    given = rows.sparkSession.sparkContext.broadcast(v)
    names = [*rows.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(ids).fill_null([])
            lens = np.array(pa.compute.list_value_length(lists), np.int64)
            got = decode_ids(lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lens))), given.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))
