"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts per language come from a bounded sample of labelled documents; the matrix of log
probabilities has languages x BUCKETS entries whatever the data, and is sent to all tasks. Documents
are scored whole, a batch at a time, with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_limit, key_hash

BUCKETS = 1 << 16
#: n-grams of one to four characters, by position of their last character.
ORDERS = (1, 2, 3, 4)
#: The labelled documents that the counts are fitted on, about; twice as many at most, since rare languages get more than their share.
MAX_TRAIN = 20_000
#: The most languages that are learnt, those with the most labelled documents: the matrix then has 64 MB.
MAX_LANGS = 256
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Characters handled at once; a longer text is handled in parts that overlap, so nothing is left out.
_CHUNK = 1 << 17


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 2 by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts together, runs of non-letters made one blank and a blank at both ends
    of each; and the text that each belongs to."""
    low = [f" {t.lower()} " for t in texts]
    owner = np.repeat(np.arange(len(low)), [len(t) for t in low])
    c = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = (c < 128) & ~((c >= 97) & (c <= 122))
    c = np.where(plain, np.uint32(32), c)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (owner[1:] != owner[:-1])
    return c[keep], owner[keep]


def _grams(codes: np.ndarray, owner: np.ndarray, lead: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and text of each n-gram, by order; those that end within the first `lead` codes are left out."""
    wide = codes.astype(np.uint64)
    for order in ORDERS:
        n = len(codes) - order + 1
        if n <= 0:
            return
        h = np.full(n, order, np.uint64)
        for k in range(order):
            h = (h ^ wide[k : k + n]) * _MIX
            h ^= h >> np.uint64(29)
        whole = owner[:n] == owner[order - 1 :]
        whole[: max(0, lead - order + 1)] = False
        yield ((h >> np.uint64(16)).astype(np.int64) & (BUCKETS - 1))[whole], owner[:n][whole]


def _parts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Codes, owners and lead of some short texts together, or of a part of a long one: parts overlap, so that
    every n-gram is in one of them."""
    first, size = 0, 0
    for i, t in enumerate([*texts, None]):
        if t is None or size + len(t) > _CHUNK:
            if first < i:
                codes, owner = _codes(texts[first:i])
                for a in range(0, len(codes), 2 * _CHUNK):
                    start = max(0, a - max(ORDERS) + 1)
                    yield codes[start : a + 2 * _CHUNK], owner[start : a + 2 * _CHUNK] + first, a - start
            first, size = i, 0
        size += len(t or "")


def counts(text: str) -> np.ndarray:
    """n-grams of a whole text by bucket."""
    out = np.zeros(BUCKETS, np.int64)
    for part in _parts([text]):
        for bucket, _ in _grams(*part):
            out += np.bincount(bucket, minlength=BUCKETS)
    return out


def fit(docs: DataFrame, *, text="text", lang="lang", key="doc_id", max_train: int = MAX_TRAIN, max_langs: int = MAX_LANGS, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities (BUCKETS x languages). All languages get equal priors.

    They are learnt from about `max_train` labelled rows, picked by a hash of `key` so that reruns agree. Each language has its
    share of them, and max_train / max_langs rows if that is more, so that a rare one is learnt from what there is.
    Rows without text, language or letters teach nothing; no such row at all gives no language. Of more than `max_langs`
    languages those with the most labelled rows are learnt (ties: the first by name), since the matrix goes to every task."""
    spark = docs.sparkSession
    labelled = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    known = labelled.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(max_langs).collect()
    whole = sum(r.n for r in known)
    shares = [(r.l, hash_limit(max(max_train * r.n // whole, max_train // max_langs, 1), r.n)) for r in known]
    # max_langs rows at most.
    limits = F.broadcast(spark.createDataFrame(shares, "l string, most bigint"))
    sample = labelled.join(limits, "l").filter(key_hash(F.col("k")) < F.col("most"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, np.ndarray] = {}
        for b in batches:
            for t, name in zip(b.column("t").to_pylist(), b.column("l").to_pylist()):
                if _LETTER.search(t):
                    by[name] = by.get(name, 0) + counts(t)
        for name, c in by.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"l": [name] * len(at), "b": at.astype(np.int32), "n": c[at]})

    def column(sums_: pa.Table) -> pa.Table:
        """One language's log probabilities from its sums by bucket, BUCKETS rows at most."""
        n = np.full(BUCKETS, smoothing)
        n[sums_.column("b").to_numpy()] += sums_.column("n").to_numpy()
        return pa.table({"l": sums_.column("l").slice(0, 1), "logp": pa.array([np.log(n / n.sum()).astype(np.float32).tobytes()], pa.binary())})

    by_bucket = sample.select("t", "l").mapInArrow(sums, "l string, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n"))
    # A row of 256 kB for each language: together the matrix that is sent out.
    learnt = by_bucket.groupBy("l").applyInArrow(column, "l string, logp binary").toArrow()
    columns = dict(zip(learnt.column("l").to_pylist(), learnt.column("logp").to_pylist()))
    names = sorted(columns)
    if not names:
        return names, np.empty((BUCKETS, 0), np.float32)
    return names, np.ascontiguousarray(np.stack([np.frombuffer(columns[x], np.float32) for x in names], axis=1))


def score_texts(texts: list[str | None], names: list[str], logp: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text. The n-grams of many texts together are one sparse matrix of counts, given
    by its rows' buckets, and its product with `logp` is a sum of the named rows for each text. The score is the
    winner's share of the posterior per root of n-grams, so that it stays below 1 for texts between languages.
    Ties: the first language by name."""
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    at = [i for i, t in enumerate(texts) if names and t is not None and _LETTER.search(t)]
    total, grams = np.zeros((len(at), len(names))), np.zeros(len(at))
    for part in _parts([texts[i] for i in at]):
        for bucket, owner in _grams(*part):
            for a in range(0, len(bucket), max(1, _CHUNK * 4 // len(names))):
                b, o = bucket[a : a + max(1, _CHUNK * 4 // len(names))], owner[a : a + max(1, _CHUNK * 4 // len(names))]
                first = np.flatnonzero(np.diff(o, prepend=-1))
                total[o[first]] += np.add.reduceat(logp.take(b, axis=0), first, axis=0, dtype=np.float64)
                grams[o[first]] += np.diff(np.append(first, len(o)))
    if at:
        best = total.argmax(axis=1)
        z = np.exp((total - total.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(1, grams))[:, None])
        scores[at] = np.minimum(1.0, z[np.arange(len(at)), best] / z.sum(axis=1))
        for i, k in zip(at, best):
            langs[i] = names[k]
    return langs, scores


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], *, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with lang_pred and score (columns of these names are replaced).

    - null text, or text without a letter, or a model without languages: `und`, score 0
    - the text alone decides, so repeated rows and ids get equal answers; ties: the first language by name
    - very long texts: scored whole, in parts of fixed size
    - extra columns stay, whatever their names; empty table: empty result"""
    kept = [c for c in docs.columns if c not in (lang_out, score_out)]
    given = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang:string,score:double>")
    def scored(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        langs, scores = score_texts([t if isinstance(t, str) else None for t in texts], *given.value)
        return pd.DataFrame({"lang": langs, "score": scores})

    found = docs.select(F.struct(*kept).alias("row"), scored(F.col(text)).alias("found"))
    return found.select(*[F.col("row")[c].alias(c) for c in kept], F.col("found.lang").alias(lang_out), F.col("found.score").alias(score_out))
