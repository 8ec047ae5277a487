"""Sets of word shingles as sorted 64-bit numbers, a batch of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64) | _U(1)
_POWER = _U(0x9E3779B97F4A7C15)
_STEP = _U(0xD1342543DE82EF95)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text handled at once, but for a longer single text.
_CHUNK = 1 << 19

HEAT_BITS = 22


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _chunks(texts: list) -> Iterator[tuple[int, list[bytes]]]:
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = b"" if t is None else t.encode("utf-8", "surrogatepass")
        if held and size + len(raw) > _CHUNK:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


def _words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word with A-Z in lower case, and the number of words of each text."""
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    stop = np.cumsum([len(r) + 1 for r in raws])
    counts = np.diff(np.searchsorted(starts, stop), prepend=0)
    if not len(starts):
        return np.empty(0, np.uint64), counts
    lens = ends - starts
    at = np.cumsum(lens) - lens
    place = np.arange(at[-1] + lens[-1]) - np.repeat(at, lens)
    power = np.cumprod(np.concatenate(([_U(1)], np.full(int(lens.max()) - 1, _POWER, np.uint64))))
    values = _BYTE[_LOWER[data[inside]]] * power[place]
    return mix(np.add.reduceat(values, at) + lens.astype(np.uint64)), counts


def shingles(texts: list, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Index and shingle hashes, in order of the text, of each text. A text of fewer words than `width`
    has one: the whole sequence; one without words has none."""
    for first, raws in _chunks(texts):
        words, counts = _words(raws)
        n = len(words) - width + 1
        if n > 0:
            grams = np.zeros(n, np.uint64)
            for k in range(width):
                grams = grams * _STEP + words[k : k + n]
            grams = mix(grams + _U(width))
        at = 0
        for i, c in enumerate(counts):
            if c >= width:
                yield first + i, grams[at : at + c - width + 1]
            elif c:
                h = _U(0)
                for w in words[at : at + c]:
                    h = _U((int(h) * int(_STEP) + int(w)) & (2**64 - 1))
                yield first + i, mix(np.array([(int(h) + int(c)) & (2**64 - 1)], np.uint64))
            else:
                yield first + i, np.empty(0, np.uint64)
            at += c


def ordered(grams: np.ndarray, heat: np.ndarray | None) -> np.ndarray:
    """The set of `grams` in the global order: by heat level, then by hash. A number is the level and
    the upper 60 bits of the hash, so it also stands for the shingle."""
    key = grams >> _U(4)
    if heat is not None:
        key = key | heat[(grams >> _U(64 - HEAT_BITS)).astype(np.int64)].astype(np.uint64) << _U(60)
    key = np.sort(key)
    keep = np.ones(len(key), bool)
    keep[1:] = key[1:] != key[:-1]
    return key[keep]
