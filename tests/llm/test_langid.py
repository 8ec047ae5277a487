"""Held-out accuracy, and what has no language."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from freightlens.llm import langid
from freightlens.llm.common import hashed_share, load
from freightlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    out = QUERIES["op8_language_id"](spark, SF).join(load(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert 0.15 < len(held) / len(out) < 0.35
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_counts_of_long_texts_are_whole(monkeypatch):
    text = "the quick brown fox über größere Straßen " * 200
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "_CHUNK", 97)
    assert (langid.counts(text) == whole).all()


def plain_grams(text):
    """Buckets of a text's n-grams in plain Python."""
    low = re.sub(r"[\x00-\x60\x7b-\x7f]+", " ", f" {text.lower()} ")
    for order in (1, 2, 3, 4):
        for i in range(len(low) - order + 1):
            h = order
            for ch in low[i : i + order]:
                h = ((h ^ ord(ch)) * 0x9E3779B97F4A7C15) % 2**64
                h ^= h >> 29
            yield (h >> 16) % langid.BUCKETS


def test_equals_plain_naive_bayes(spark):
    rows = load(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang").collect()
    rows = [(r.doc_id, r.text and r.text[:3000], r.lang) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    table = {}
    for _, t, g in rows:
        if t and g and re.search(r"[^\W\d_]", t):
            table.setdefault(g, Counter()).update(plain_grams(t))
    names = sorted(table)
    whole = {g: sum(c.values()) + 0.5 * langid.BUCKETS for g, c in table.items()}
    logp = {g: {b: math.log((n + 0.5) / whole[g]) for b, n in c.items()} for g, c in table.items()}
    model = langid.fit(docs)
    assert model[0] == names
    for k, g in enumerate(names):
        want = np.full(langid.BUCKETS, math.log(0.5 / whole[g]))
        want[list(logp[g])] = list(logp[g].values())
        assert np.allclose(model[1][:, k], want, rtol=1e-6)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for d, t, _ in rows:
        if not t or not re.search(r"[^\W\d_]", t):
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
            continue
        grams = list(plain_grams(t))
        total = [sum(logp[g].get(b, math.log(0.5 / whole[g])) for b in grams) for g in names]
        z = [math.exp((x - max(total)) / math.sqrt(len(grams))) for x in total]
        assert got[d].lang_pred == names[total.index(max(total))] and abs(got[d].score - max(z) / sum(z)) < 1e-3


def test_samples_never_vanish(spark):
    """Of 10**12 keys some are still wanted, at the rate asked for."""
    keys = spark.range(20_000_000)
    assert 0 < keys.filter(hashed_share(F.col("id"), 10**6, 10**12)).count() < 60
    assert keys.limit(1000).filter(hashed_share(F.col("id"), 10**6, 10)).count() == 1000
    assert keys.limit(1000).filter(hashed_share(F.col("id"), 0, 10)).count() == 0


def test_of_many_languages_the_commonest_are_learnt(spark):
    docs = spark.createDataFrame([(i, "text", f"l{i:03d}") for i in range(300)] + [(300 + i, "text", f"l{i:03d}") for i in range(290, 300)], "doc_id long, text string, lang string")
    assert langid.fit(docs)[0] == [f"l{i:03d}" for i in [*range(246), *range(290, 300)]]
    assert langid.fit(docs, max_langs=12)[0] == ["l000", "l001", *[f"l{i:03d}" for i in range(290, 300)]]
    assert langid.predict(docs, langid.fit(docs)).filter("lang_pred is null").isEmpty()


def test_rare_languages_are_learnt(spark):
    """One document in 20,001 is far from its share of a sample of 256."""
    rows = spark.range(20_000).selectExpr("id as doc_id", "'the cat and the dog' as text", "'en' as lang")
    rare = spark.createDataFrame([(30_000, "собака и кошка гуляли по двору", "ru")], "doc_id long, text string, lang string")
    model = langid.fit(rows.unionByName(rare), max_train=256)
    assert model[0] == ["en", "ru"]
    assert langid.predict(rare, model).first().lang_pred == "ru"


def test_odd_rows(spark):
    train = spark.createDataFrame([(1, "the cat and the dog", "en", 0), (2, "der hund und die katze", "de", 0), (3, None, "fr", 0), (4, "texte", None, 0), (5, "123", "xx", 0)], "doc_id long, text string, lang string, score int")
    model = langid.fit(train)
    assert model[0] == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "12 + 34 … ½"), (4, "the the"), (5, "und der"), (6, "漢"), (None, "the dog " * 50_000), (4, "the the")]
    out = langid.predict(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang_pred string").selectExpr("*", "1 as _lid", "2 as found", "3 as row"), model)
    assert out.columns == ["doc_id", "text", "_lid", "found", "row", "lang_pred", "score"]
    got = [(r.doc_id, r.lang_pred, r.score) for r in out.collect()]
    assert [x[1] for x in got[:5]] == ["und"] * 3 + ["en", "de"] and [x[2] for x in got[:3]] == [0.0] * 3
    assert got[5][1] in ("de", "en") and got[6][1] == "en" and got[3] == got[7]
    nothing = langid.fit(train.limit(0))
    assert nothing[0] == [] and langid.predict(train, nothing).select("lang_pred").distinct().collect()[0][0] == "und"
    assert langid.predict(train.limit(0), model).collect() == []


def test_ids_languages_and_sources_do_not_decide(spark):
    model = langid.fit(load(spark, SF, "documents").limit(300))
    docs = load(spark, SF, "documents").limit(50)
    changed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("s"), "doc_id": F.col("doc_id") + 10**6})
    a, b = ([r.lang_pred for r in langid.predict(d, model).orderBy("doc_id").collect()] for d in (docs, changed))
    assert a == b
