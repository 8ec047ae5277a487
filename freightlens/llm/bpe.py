"""BPE encoding and decoding: a greedy cut is proposed, checked pair by pair, and merged exactly only where it fails.

For each new word the longest token is taken again and again. The cut is the one that merging gives exactly if every
token merges to itself alone and no two neighbours would have merged otherwise across their border: merges are undone
backwards on both sides of it, the younger first, and at each step the two tokens at the border must have no merge
older than what was undone. This is tested for all distinct pairs of a batch at once, in arrays. The words of failing
pairs are merged pair by pair in order of rank, as BPE is defined.

White space of ASCII never lies within a word of the supported tokenizers, and nothing composes across it, so a
text is its chunks between white space one after the other; a task remembers the ids of chunks and of words.
Failing words of one length are merged together, a merge of each at a time; very long ones by a heap.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .pieces import double_array

#: Chunks and words that a task remembers, and the longest of them in bytes.
MEMORY, SHORT = 500_000, 128
#: Bytes of a text that are split at once, and chunks that are looked up together.
SECTION, TOGETHER = 1 << 20, 1 << 17
#: Bytes of the words that are cut greedily in step with each other; longer ones are cut alone.
STEPPED = 48
#: Stands for the end of a word in the trie; no text holds it.
END = 0xFF
#: Tokens that are decoded at once.
PIECES = 1 << 18
#: Characters below this one are letters, digits, blanks and capitals alike in all versions of Unicode, and none
#: composes with another; chunks with others are normalised by the tokenizers library.
SETTLED = "ɐ"
_BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is printed in Latin-1, else the next one from U+0100."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printed else chr(next(others)) for b in range(256)]


@dataclass(frozen=True)
class Model:
    """tokens: their texts by id. first and last: id of each byte within and at the end of a word. left and right: the
    two tokens that were merged to one, -1 for bytes. rank: the younger, the greater, -1 for bytes. keys: sorted,
    left << 32 | right, with `merged` the token of each. whole: tokens that merging cuts no further. trie: base, check
    and value of a double array of these."""

    source: str
    tokens: list[str]
    special: dict[str, int]
    pattern: str
    suffix: str
    inner: dict[bytes, int]
    final: dict[bytes, int]
    left: np.ndarray
    right: np.ndarray
    rank: np.ndarray
    keys: np.ndarray
    merged: np.ndarray
    first: list[int]
    last: list[int]
    whole: np.ndarray = field(default_factory=lambda: np.empty(0, bool))
    trie: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def from_file(path: str) -> Model:
    """The model of a tokenizer file: BPE with a suffix at the ends of words, over the bytes of lower-case text in NFC,
    cut by a pattern whose matches hold no white space."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    t = json.loads(source)
    m = t["model"]
    normal, before = (t["normalizer"] or {}).get("normalizers", []), (t["pre_tokenizer"] or {}).get("pretokenizers", [])
    known = [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in before] == ["Split", "ByteLevel"]
    known &= bool(m["type"] == "BPE" and m.get("end_of_word_suffix")) and not any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    if not known or t["decoder"] or before[0]["behavior"] != "Removed" or not before[0]["invert"] or before[1]["use_regex"] or before[1]["add_prefix_space"]:
        raise ValueError(f"{path} is no tokenizer of the supported kind")
    special = {a["content"]: a["id"] for a in t["added_tokens"]}
    if any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] or _BLANK.search(a["content"].encode()) for a in t["added_tokens"]):
        raise ValueError(f"{path} has added tokens of another kind")
    vocab, suffix, signs = m["vocab"], m["end_of_word_suffix"], byte_characters()
    n = max([*vocab.values(), *special.values()]) + 1
    tokens = [""] * n
    for w, i in [*vocab.items(), *special.items()]:
        tokens[i] = w
    pairs = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in m["merges"]]
    left, right, rank = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    for r, (a, b) in enumerate(pairs):
        i = vocab[a + b]
        if rank[i] >= 0:
            raise ValueError(f"{path} makes a token by two merges")
        left[i], right[i], rank[i] = vocab[a], vocab[b], r
    made = np.flatnonzero(rank >= 0)
    keys = left[made] << 32 | right[made]
    order = np.argsort(keys)
    byte = {c: b for b, c in enumerate(signs)}
    inner, final = {}, {}
    for w, i in vocab.items():
        ends = w.endswith(suffix) and len(w) > len(suffix)
        (final if ends else inner)[bytes(byte[c] for c in (w[: -len(suffix)] if ends else w))] = i
    model = Model(source, tokens, special, before[0]["pattern"]["Regex"], suffix, inner, final, left, right, rank, keys[order], made[order], [vocab[c] for c in signs], [vocab[c + suffix] for c in signs])
    exact = Exact(model)
    whole = np.zeros(n, bool)
    for words, ends in ((inner, False), (final, True)):
        for w, i in words.items():
            whole[i] = exact.merge([*(model.first[b] for b in w[:-1]), (model.last if ends else model.first)[w[-1]]]) == [i]
    words = {w: i for w, i in inner.items() if whole[i]} | {w + bytes([END]): i for w, i in final.items() if whole[i]}
    return replace(model, whole=whole, trie=double_array({w: i for w, i in words.items() if END not in w[:-1] and w != bytes([END])}))


class Exact:
    """BPE as it is defined: of all neighbours that may merge, those of the least rank, the leftmost first."""

    def __init__(self, m: Model):
        self.table = dict(zip(m.keys.tolist(), zip(m.rank[m.merged].tolist(), m.merged.tolist())))

    def merge(self, symbols: list[int]) -> list[int]:
        n, table = len(symbols), self.table
        if n < 2:
            return list(symbols)
        at, after, back = array("q", symbols), array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        # One number a candidate: rank, then place. A merge keeps the place of its left part.
        heap = [found[0] * n + i for i in range(n - 1) if (found := table.get(at[i] << 32 | at[i + 1]))]
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            if at[i] < 0 or j >= n or (found := table.get(at[i] << 32 | at[j])) is None or found[0] != r:
                continue
            at[i], at[j] = found[1], -1
            k = after[i] = after[j]
            if k < n:
                back[k] = i
                if found := table.get(at[i] << 32 | at[k]):
                    heapq.heappush(heap, found[0] * n + i)
            if (h := back[i]) >= 0 and (found := table.get(at[h] << 32 | at[i])):
                heapq.heappush(heap, found[0] * n + h)
        return [x for x in at if x >= 0]


NEVER = np.iinfo(np.int64).max


def _merges(m: Model, l: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """Rank of each pair's merge, NEVER without one, and the token that it makes."""
    key = l << 32 | r
    place = np.minimum(np.searchsorted(m.keys, key), len(m.keys) - 1)
    made = m.merged[place]
    return np.where(m.keys[place] == key, m.rank[made], NEVER), made


def merged(m: Model, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """words: a row of symbols each, all of one length. Yields numbers of rows and their tokens, as `Exact` merges them.
    Each row makes its first merge in each turn, so those that go on keep one length."""
    at = np.arange(len(words))
    rank, made = _merges(m, words[:, :-1], words[:, 1:])
    while True:
        here = np.arange(len(words))
        first = rank.argmin(axis=1) if rank.shape[1] else here
        go = rank[here, first] < NEVER if rank.shape[1] else np.zeros(len(words), bool)
        if not go.all():
            yield at[~go], words[~go]
            at, words, rank, made, first = at[go], words[go], rank[go], made[go], first[go]
            here = np.arange(len(words))
        if not len(words):
            return
        words[here, first] = made[here, first]
        keep = np.ones(words.shape, bool)
        keep[here, first + 1] = False
        words = words[keep].reshape(len(words), -1)
        rank, made = (x[keep[:, 1:]].reshape(len(words), -1) for x in (rank, made))
        for beside in (first - 1, first):
            some = np.flatnonzero((beside >= 0) & (beside < rank.shape[1]))
            j = beside[some]
            rank[some, j], made[some, j] = _merges(m, words[some, j], words[some, j + 1])


def compatible(m: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging a's and b's bytes together gives a and b again, for tokens that are whole."""
    ok = np.ones(len(a), bool)
    at, l, r = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
    limit = np.full(len(a), NEVER)
    while len(at):
        merges = _merges(m, l, r)[0] < limit
        ok[at[merges]] = False
        # Of equal ranks the right one is younger, as merges go from left to right; a merge of the
        # rank at which the right token was taken up comes before that, one of the left token's comes after.
        rl, rr = m.rank[l], m.rank[r]
        undo_left = rl > rr
        limit = np.where(undo_left, rl, rr + 1)
        left = ~merges & (np.maximum(rl, rr) >= 0)
        l, r = np.where(undo_left, m.right[l], l)[left], np.where(undo_left, r, m.left[r])[left]
        limit, at = limit[left], at[left]
    return ok


class Encoder:
    """Ids of texts as bytes of little-endian 32-bit numbers."""

    def __init__(self, m: Model):
        self.m, self.exact = m, Exact(m)
        whole = m.whole.tolist()
        self.inner, self.final = ({w: i for w, i in d.items() if whole[i]} for d in (m.inner, m.final))
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.first, self.last = np.array(m.first, np.int64), np.array(m.last, np.int64)
        self.pattern = regex.compile(m.pattern)
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(m.special, key=len, reverse=True)) + ")") if m.special else None
        self.byte = {c: b for b, c in enumerate(byte_characters())}
        #: Ids of chunks, and of words with a blank in front; for a chunk of small ASCII letters both are the same.
        self.known: dict[bytes, bytes] = {}
        self._library = None
        #: Words that were cut, and those of them that had to be merged.
        self.seen = self.failed = 0

    def _normalised(self, text: str) -> list[bytes]:
        """Words of a chunk by the library, for characters whose treatment depends on the version of Unicode."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.m.source)
        found = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(self.byte[c] for c in w) for w, _ in found if w]

    def _split(self, chunk: bytes) -> list[bytes | int]:
        """Words, and ids of added tokens, in order."""
        text = chunk.decode("utf-8", "replace")
        parts = self.special.split(text) if self.special and "<" in text else [text]
        out: list[bytes | int] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.m.special[part])
            elif part:
                out += [w.encode() for w in self.pattern.findall(part.lower())] if max(part) < SETTLED else self._normalised(part)
        return out

    def _greedy(self, word: bytes) -> list[int]:
        out, at, n = [], 0, len(word)
        inner, final, longest = self.inner, self.final, self.longest
        while True:
            if n - at <= longest and (i := final.get(word[at:])) is not None:
                out.append(i)
                return out
            for end in range(min(n - 1, at + longest), at, -1):
                if (i := inner.get(word[at:end])) is not None:
                    out.append(i)
                    at = end
                    break

    def _greedy_together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, cut in step with each other, and their number in each word."""
        base, check, value = self.m.trie
        flat = np.frombuffer(b"".join(w + bytes([END]) for w in words), np.uint8).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begin = np.cumsum(size) - size
        who, at, end = np.arange(len(words)), begin.copy(), begin + size
        node, best, best_end = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), begin.copy()
        found = []
        while len(who):
            child = base[node] + flat[np.minimum(at, end - 1)]
            on = (at < end) & (check[child] == node)
            at, node = np.where(on, at + 1, at), np.where(on, child, node)
            # Before its end mark a word leaves a byte at least, as the last byte's token has the suffix.
            hit = on & (value[node] >= 0) & (at != end - 1)
            best, best_end = np.where(hit, value[node], best), np.where(hit, at, best_end)
            stop = np.flatnonzero(~on)
            if len(stop):
                found.append((who[stop], best[stop]))
                at[stop], node[stop] = best_end[stop], 0
                left = best_end < end
                left[on] = True
                who, at, end, node, best, best_end = (x[left] for x in (who, at, end, node, best, best_end))
        owner, ids = (np.concatenate(x) for x in zip(*found))
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def cut(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as bytes."""
        short = [w for w in words if len(w) <= STEPPED]
        ids, count = self._greedy_together(short) if short else (np.empty(0, np.int64), np.empty(0, np.int64))
        if len(short) < len(words):
            alone = np.array([len(w) > STEPPED for w in words])
            counts, flat, at = np.zeros(len(words), np.int64), [], 0
            counts[~alone] = count
            for k in np.flatnonzero(alone).tolist():
                upto = int(counts[at:k].sum())
                one = self._greedy(words[k])
                counts[k] = len(one)
                flat += [ids[:upto], np.array(one, np.int64)]
                ids, at = ids[upto:], k + 1
            ids, count = np.concatenate([*flat, ids]), counts
        owner = np.repeat(np.arange(len(words)), count)
        near = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(ids[near] << 32 | ids[near + 1], return_inverse=True)
        ok = compatible(self.m, pairs >> 32, pairs & 0xFFFFFFFF)
        raw, ends = memoryview(ids.astype("<u4").tobytes()), (4 * np.cumsum(count)).tolist()
        out = [raw[a:b].tobytes() for a, b in zip([0, *ends], ends)]
        bad = np.unique(owner[near[~ok[which]]]).tolist()
        self.seen += len(words)
        self.failed += len(bad)
        by_size: dict[int, list[int]] = {}
        for k in bad:
            by_size.setdefault(len(words[k]), []).append(k)
        for size, some in by_size.items():
            bytes_ = np.frombuffer(b"".join(words[k] for k in some), np.uint8).reshape(len(some), size)
            symbols = np.concatenate((self.first[bytes_[:, :-1]], self.last[bytes_[:, -1:]]), axis=1)
            if size > SHORT:
                for k, row in zip(some, symbols):
                    out[k] = array("I", self.exact.merge(row.tolist())).tobytes()
                continue
            for rows, tokens in merged(self.m, symbols):
                for i, t in zip(rows.tolist(), tokens.astype("<u4")):
                    out[some[i]] = t.tobytes()
        return out

    def _learn(self, chunks: Iterable[bytes]) -> dict[bytes, bytes]:
        plain = {c: c.lower() for c in chunks if c.isalpha()}
        parts = {c: tuple([w if type(w) is int or w.isalpha() else b" " + w for w in self._split(c)]) for c in chunks if c not in plain}
        new = {w for p in parts.values() for w in p if type(w) is bytes}
        new = list(new.union(plain.values()).difference(self.known))
        found = {w: ids for w, ids in zip(new, self.cut([w.lstrip(b" ") for w in new]))} if new else {}
        one = lambda p: p.to_bytes(4, "little") if type(p) is int else found.get(p) or self.known[p]
        out = {c: one(w) for c, w in plain.items()}
        for c, p in parts.items():
            out[c] = one(p[0]) if len(p) == 1 else b"".join(map(one, p))
        self.known |= {w: ids for w, ids in found.items() if len(w) <= SHORT}
        return out

    def ids(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk."""
        if len(self.known) > MEMORY:
            self.known.clear()
        got = list(map(self.known.get, chunks))
        missing = [i for i, ids in enumerate(got) if ids is None]
        if missing:
            new = self._learn({chunks[i] for i in missing})
            for i in missing:
                got[i] = new[chunks[i]]
            self.known |= {c: ids for c, ids in new.items() if len(c) <= SHORT}
        return got

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text; null is the empty text."""
        out: list[list[bytes]] = []
        chunks, ends = [], []

        def flush() -> None:
            got, a = self.ids(chunks), 0
            for owner, b in ends:
                out[owner].append(b"".join(got[a:b]))
                a = b
            chunks.clear()
            ends.clear()

        for k, text in enumerate(texts):
            out.append([])
            raw = (text or "").encode("utf-8", "replace")
            for section in _sections(raw):
                chunks += section.split()
                ends.append((k, len(chunks)))
                if len(chunks) >= TOGETHER:
                    flush()
        flush()
        return [b"".join(o) for o in out]


def _sections(raw: bytes) -> Iterator[bytes]:
    """Parts of a text of about SECTION bytes that end at white space."""
    at = 0
    while at < len(raw):
        end = at + SECTION
        end = m.end() if end < len(raw) and (m := _BLANK.search(raw, end)) else len(raw)
        yield raw[at:end]
        at = end


def encode(docs: DataFrame, m: Model, *, text: str = "text", out: str = "token_ids") -> DataFrame:
    """docs with the ids of each whole text (a column named `out` is replaced).

    - null or empty text, and one of white space alone: no ids. Equal texts, so also repeated rows, give equal ids
    - ties: merges of one rank go from left to right
    - the strings of added tokens in a text become those tokens, as the tokenizers library has it
    - very long texts: encoded whole, a section at a time; very long words: whole, with some 100 bytes for each byte
    - extra columns stay; empty table: empty result"""
    docs = docs.drop(out)
    given = docs.sparkSession.sparkContext.broadcast(m)
    names = [*docs.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(given.value)
        for b in batches:
            got = encoder.encode(x.as_py() for x in b.column(text))
            off = np.cumsum([0, *(len(g) // 4 for g in got)])
            column = pa.ListArray.from_arrays(off.astype(np.int32), np.frombuffer(b"".join(got), np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, column], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode_ids(ids: np.ndarray, off: np.ndarray, tokens: list[str]) -> list[bytes]:
    """The tokens of each id list with a blank between them, in UTF-8."""
    words = [f"{t} ".encode() for t in tokens]
    size = np.array([len(w) for w in words], np.int64)
    store, begin = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
    parts = []
    for a in range(0, len(ids), PIECES):
        some = ids[a : a + PIECES]
        upto = np.cumsum(size[some])
        parts.append(store[np.repeat(begin[some] - (upto - size[some]), size[some]) + np.arange(upto[-1])].tobytes())
    raw = b"".join(parts)
    ends = np.concatenate(([0], np.cumsum(size[ids])))[off]
    return [raw[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def decode(rows: DataFrame, m: Model, *, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """rows with the text of each id list (a column named `out` is replaced): its tokens with a blank between them, as
    a tokenizer without a decoder gives it. Null and empty lists: the empty text; a null id, or one
    that is no token's, is left out. Repeated rows decode alike; extra columns stay."""
    rows = rows.drop(out)
    known = np.array([bool(t) for t in m.tokens])
    given = rows.sparkSession.sparkContext.broadcast((m.tokens, known))
    names = [*rows.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, known = given.value
        for b in batches:
            lists = b.column(ids).fill_null([])
            flat = lists.flatten()
            count = np.array(pc.list_value_length(lists), np.int64)
            some = flat.fill_null(-1).to_numpy().astype(np.int64)
            good = (some >= 0) & (some < len(tokens))
            good[good] = known[some[good]]
            before = np.concatenate(([0], np.cumsum(good)))
            got = decode_ids(some[good], before[np.concatenate(([0], np.cumsum(count)))], tokens)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


def as_bytes(rows: DataFrame, *, ids: str = "token_ids", out: str = "id_bytes") -> DataFrame:
    """rows with each id list as little-endian unsigned 32-bit numbers (a column named `out` is replaced). Null: no bytes."""
    rows = rows.drop(out)
    names = [*rows.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(ids).fill_null([])
            count = np.array(pc.list_value_length(lists), np.int64)
            raw = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False)).astype("<u4").tobytes())
            ends = np.concatenate(([0], 4 * np.cumsum(count))).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([raw[a:c].tobytes() for a, c in zip(ends, ends[1:])], pa.binary())], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType())]))
