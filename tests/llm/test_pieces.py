"""Viterbi against a plain dynamic programme, and exact round trips."""

import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from freightlens.llm import pieces
from freightlens.llm.queries import QUERIES, TOKENIZER


ROOT = Path(__file__).parents[2]


def toy(seed=0):
    rng = random.Random(seed)
    names = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)]]
    names += sorted({("▁" * rng.randint(0, 2)) + "".join(rng.choice("abcdé漢") for _ in range(rng.randint(1, 4))) for _ in range(120)} | {"▁", "▁▁▁", "a", "b"})
    # Multiples of 1/1024: sums are exact, so equal cuts tie however they are added up.
    return pieces.vocabulary(names, [0.0] * 257 + [-rng.randrange(9 * 1024) / 1024 for _ in names[257:]], list(range(1, 257)), {0})


def plain(v, text):
    """Best cut of the whole text at once, without words."""
    s = " " + text
    known = {p: i for i, p in reversed(list(enumerate(v.pieces))) if i > 256}
    best, back = [0.0] + [-np.inf] * len(s), [None] * (len(s) + 1)
    for a in range(len(s)):
        for b in range(a + 1, min(len(s), a + 8) + 1):
            i = known.get(s[a:b].encode())
            if i is None and b > a + 1:
                continue
            gain = v.scores[i] if i is not None else v.scores.min() - pieces.PENALTY
            if best[a] + gain > best[b]:
                best[b], back[b] = best[a] + gain, (a, [i] if i is not None else [int(v.byte_ids[x]) for x in s[a:b].encode()])
    out, at = [], len(s)
    while at:
        at, ids = back[at][0], back[at][1]
        out = ids + out
    return out


@pytest.mark.parametrize("seed", range(3))
def test_viterbi_is_the_best_cut(seed):
    v, rng = toy(seed), random.Random(seed)
    texts = ["".join(rng.choice("aabbcdé漢 \n\t𝔘") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    encoder = pieces.Encoder(v)
    ids, off = encoder.encode(texts)
    for t, a, b in zip(texts, off, off[1:]):
        assert ids[a:b].tolist() == plain(v, t), t
    assert pieces.decode_ids(ids, off, v) == texts


def test_double_array_holds_the_words():
    words = {w.encode(): i for i, w in enumerate(["a", "ab", "abc", "b", "é", "漢字", " x", "xyz"])}
    base, check, value = pieces.double_array(words)

    def find(w):
        s = 0
        for c in w:
            t = base[s] + c
            if base[s] <= 0 or t >= len(check) or check[t] != s:
                return -1
            s = t
        return value[s]

    assert all(find(w) == i for w, i in words.items())
    assert [find(x) for x in (b"", b"ac", b"abcd", b"x", b"z")] == [-1] * 5


def test_forgetting_words_changes_nothing(monkeypatch):
    v, texts = toy(), [f"a{i} bcd é▁x {i * 7}" for i in range(50)]
    whole = pieces.Encoder(v).encode(texts)
    monkeypatch.setattr(pieces, "MEMORY", 12)
    small = pieces.Encoder(v)
    parts = [small.encode(texts[i : i + 3]) for i in range(0, 50, 3)]
    assert np.concatenate([p[0] for p in parts]).tolist() == whole[0].tolist()


def test_documents(spark):
    v = pieces.from_model(TOKENIZER)
    texts = [None, "", " ", "  two  blanks ", "line\n\nbreak\ttab", "▁ marker ▁▁", "𝔘 ퟿ 漢字かな", "same", "same", "x" * 3000, "many words " * 20_000]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, token_ids string")
    out = pieces.decode(pieces.encode(df, v), v).orderBy("doc_id").collect()
    assert [r.decoded for r in out] == [t or "" for t in texts]
    assert out[0].token_ids == out[1].token_ids == [] and out[7].token_ids == out[8].token_ids
    assert pieces.encode(df.limit(0), v).collect() == []


def test_bad_vocabularies():
    with pytest.raises(ValueError):
        pieces.vocabulary(["a▁b"], [0.0], list(range(256)))
    with pytest.raises(ValueError):
        pieces.vocabulary(["a"], [0.0], [])


@pytest.mark.parametrize("window", [7, 64, 1 << 15])
def test_windows_of_long_words(monkeypatch, window):
    v, rng = toy(1), random.Random(1)
    texts = ["".join(rng.choice("aabbcdé漢\t𝔘") for _ in range(n)) + tail for n in (1, 5, 30, 200, 2000) for tail in ("", " and more", "\n")]
    whole = pieces.Encoder(v).encode(texts)
    monkeypatch.setattr(pieces, "LONG", 3)
    monkeypatch.setattr(pieces, "WINDOW", window)
    monkeypatch.setattr(pieces, "SECTION", 10)
    cut = pieces.Encoder(v).encode(texts)
    assert cut[0].tolist() == whole[0].tolist() and cut[1].tolist() == whole[1].tolist()
    assert pieces.decode_ids(*cut, v) == texts


def test_memory_of_a_very_long_word():
    """4 MB without a blank, in a process of its own."""
    code = """
import base64, random, resource, sys
from freightlens.llm import pieces
from freightlens.llm.queries import QUERIES, TOKENIZER
v = pieces.from_model(TOKENIZER)
text = base64.b64encode(random.Random(1).randbytes(3_000_000)).decode()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
ids, off = pieces.Encoder(v).encode([text])
assert pieces.decode_ids(ids, off, v) == [text]
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, check=True)
    assert float(out.stdout.split()[-1]) < 250


def test_whole_table(spark):
    """Every text comes back, and the ids of short texts are those of a plain dynamic programme."""
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    out = QUERIES["op4_unigram_pieces"](spark, "/root/testdata/sf0.001").collect()
    assert len(out) == len(texts) and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in out)
    v = pieces.from_model(TOKENIZER)
    short = sorted((r for r in out if texts[r.doc_id]), key=lambda r: len(texts[r.doc_id]))[:40]
    best = {p: i for i, p in reversed(list(enumerate(v.pieces))) if i not in set(v.byte_ids.tolist()) and i > 2}
    for r in short:
        s = " " + texts[r.doc_id]
        score = [0.0] + [-np.inf] * len(s)
        for a in range(len(s)):
            for b in range(a + 1, min(len(s), a + 40) + 1):
                i = best.get(s[a:b].encode())
                if i is not None or b == a + 1:
                    score[b] = max(score[b], score[a] + (v.scores[i] if i is not None else v.scores.min() - pieces.PENALTY))
        fallback, got = set(v.byte_ids.tolist()), 0.0
        for i in r.token_ids:
            if i in fallback:  # the first byte of a character pays for all of it
                got += (v.scores.min() - pieces.PENALTY) if v.pieces[i][0] & 0xC0 != 0x80 else 0.0
            else:
                got += v.scores[i]
        assert abs(got - score[-1]) < 1e-6 * max(1, abs(score[-1])), r.doc_id
