"""Rank and select against plain counts, cuts against a regular expression, exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightlens.llm import infill
from freightlens.llm.queries import QUERIES


def plain(key, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or any(k in text for k in infill.MARKS) or h[2] % 100 >= 90:
        return n, "plain", text, None, None
    if h[3] % 100 < 20:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


@pytest.mark.parametrize("n,share", [(0, 0.5), (1, 1.0), (511, 0.5), (512, 0.5), (513, 0.0), (5000, 0.02), (40_000, 0.9)])
def test_rank_and_select(n, share):
    bits = np.random.default_rng(n).random(n) < share
    packed = np.zeros(-(-n // 512) * infill.BLOCK, np.uint8)
    some = np.packbits(bits)
    packed[: len(some)] = some
    rs = infill.RankSelect(packed, n)
    before = np.concatenate(([0], np.cumsum(bits)))
    assert rs.total == before[-1]
    assert rs.rank(np.arange(n + 1)).tolist() == before.tolist()
    assert rs.select(np.arange(rs.total + 2)).tolist() == [*np.flatnonzero(bits).tolist(), n, n]


@pytest.mark.parametrize("cut", [512, 1 << 20])
def test_cuts(spark, monkeypatch, cut):
    rng = random.Random(2)
    texts = [None, "", "a", "é", "<P>", "x<M>y", "ab cd", "\n", "Zz9漢字\r\nq", "word " * 30_000, "É" * 5000, "q" * 20_000, "<", "<P", "S>"]
    texts += ["".join(rng.choice("abZ é漢😀<P>SM\n\x00") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    rows = [(None if i % 17 == 0 else i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, form string, row int").coalesce(2)
    if cut == 512:
        docs = docs.filter("length(text) < 6000 or text is null")
        raw = "".join(t or "" for _, t in rows if t is None or len(t) < 6000).encode()
        monkeypatch.setattr(infill, "SLICE", cut)
        units, _ = infill.boundaries(np.frombuffer(raw, np.uint8), np.zeros(1, np.int64))
        assert units.total == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", raw.decode()))
    out = infill.transform(docs).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert out[0].__fields__ == ["doc_id", "text", "row", "n_units", "form", "output", "prefix_chars", "middle_chars", "back"]
    assert len(out) == docs.count() and {r.form for r in out} == {"plain", "psm", "spm"}
    for r in out:
        assert (r.n_units, r.form, r.output, r.prefix_chars, r.middle_chars) == plain(r.doc_id, r.text)
        assert r.back == (r.text or "")


def test_other_marks_and_empty_tables(spark):
    rules = infill.Rules(plain_from=100, spm_below=50, marks=("[p.]", "[s\\E]", "[m*"))
    docs = spark.createDataFrame([(i, f"some text, {i}. and more") for i in range(60)], "id long, body string")
    out = infill.transform(docs, text="body", key="id", seed="7", rules=rules)
    rows = out.withColumn("back", infill.restored(F.col("output"), F.col("form"), rules)).collect()
    assert {r.form for r in rows} == {"psm", "spm"} and all(r.back == r.body for r in rows)
    assert infill.transform(docs.limit(0), text="body", key="id").count() == 0
    with pytest.raises(ValueError):
        infill.Rules(marks=("<a", "<a", "<b"))
    with pytest.raises(ValueError):
        infill.Rules(marks=("<a<", "<b", "<c"))


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = QUERIES["op13_fill_in_middle"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        n, form, output, p, m = plain(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(output), sha(docs[r.doc_id] or ""))
