"""Secret scans over a trigram index.

From each rule's regex a Boolean query over trigrams is derived: alternatives of trigrams that every
match must hold. Postings (trigram, document) are built for the trigrams that the rules ask for, and
intersecting them leaves each rule's candidates; only those are searched with the regex. A rule that
has an alternative without a mandatory trigram is tried on every text. All steps on the data are
DataFrame functions.
"""

from __future__ import annotations

import re._constants as op
import re._parser as regex_parser
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, running


@dataclass(frozen=True)
class Rule:
    """A match counts if group `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The first three are the base rules. Runs are maximal, so a least length within the pattern of access
#: and hex leaves out the same matches as dropping them later.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")
#: More alternatives than this, and the part of the regex counts as anything.
MOST = 64
#: Trigrams told apart by the bits of one number, and rules by those of another.
WORD_BITS = 62
SPAN = "struct<start:int,kind:int,end:int>"
#: Words of WORD_BITS bits of the map of candidates: some 40 MB where it is full, whatever the data.
MAP_WORDS = 1 << 20
#: Code points of the segments that a text is cut into for masking.
SEGMENT = 1024


def _literals(items) -> list[str]:  # noqa: ANN001
    """Strings of which every match holds one; \\n stands for whatever the regex leaves open."""
    alternatives = [""]
    for kind, arg in items:
        if kind is op.LITERAL:
            part = [chr(arg).lower()]
        elif kind is op.IN and len(arg) <= 8 and all(k is op.LITERAL for k, _ in arg):
            part = sorted({chr(c).lower() for _, c in arg})
        elif kind is op.SUBPATTERN:
            part = _literals(arg[-1])
        elif kind is op.BRANCH:
            part = sorted({x for branch in arg[1] for x in _literals(branch)})
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, inner = arg
            once = _literals(inner)
            part = ["", *once] if (low, high) == (0, 1) else ["\n"] if low == 0 else [x + ("" if high == 1 else "\n") for x in once]
        elif kind is op.AT:
            part = [""]
        else:
            part = ["\n"]
        if len(alternatives) * len(part) > MOST:
            part = ["\n"]
        alternatives = [a + b for a in alternatives for b in part]
    return alternatives


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Any of the sets must be in a text whole, in lower case, for the regex to match; None: no such demand."""
    found = {frozenset(run[i : i + 3] for run in s.split("\n") for i in range(len(run) - 2)) for s in _literals(regex_parser.parse(pattern))}
    found = {s for s in found if not any(o < s for o in found)}
    return None if frozenset() in found else sorted(found, key=sorted)


def _key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("string"), F.lit("|"), F.col(text))


def postings(docs: DataFrame, grams: Sequence[str], *, doc_id="doc_id", text="text") -> DataFrame:
    """gram (position in `grams`), key: one row for each asked trigram that a text holds in either case."""
    low = docs.select(_key(doc_id, text).alias("key"), F.lower(text).alias("_low"))
    held = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    return low.select("key", F.explode(held).alias("gram"))


def candidates(docs: DataFrame, rules: Sequence[Rule] = RULES, *, doc_id="doc_id", text="text") -> DataFrame:
    """key, rules: a bit per rule whose trigram query the postings of a text satisfy."""
    if len(rules) > WORD_BITS:
        raise ValueError(f"more than {WORD_BITS} rules: scan with fewer at a time")
    asked = [trigram_query(r.pattern) for r in rules]
    grams = sorted({g for q in asked for s in q or [] for g in s})
    at = {g: divmod(i, WORD_BITS) for i, g in enumerate(grams)}
    words = range(-(-len(grams) // WORD_BITS))
    bit = F.expr(f"shiftleft(1L, gram % {WORD_BITS})")
    # The first column keeps the aggregate whole where no rule asks for a trigram.
    of_word = [F.bit_or(F.when(F.floor(F.col("gram") / WORD_BITS) == w, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"_held{w}") for w in words]
    held = postings(docs, grams, doc_id=doc_id, text=text).groupBy("key").agg(F.lit(0).alias("_any"), *of_word)
    bits = F.lit(0).cast("bigint")
    for i, q in enumerate(asked):
        if q is not None:
            any_of = F.lit(False)
            for s in q:
                all_of = F.lit(True)
                for w in words:
                    if mask := sum(1 << at[g][1] for g in s if at[g][0] == w):
                        all_of = all_of & (F.col(f"_held{w}").bitwiseAND(F.lit(mask).cast("bigint")) == mask)
                any_of = any_of | all_of
            bits = bits + F.when(any_of, F.lit(1 << i).cast("bigint")).otherwise(0)
    return held.select("key", bits.alias("rules")).filter("rules > 0")


def _map_place(key: Column) -> tuple[Column, Column]:
    """Word and bit of a key in the map of candidates."""
    return F.pmod(key, F.lit(MAP_WORDS)).alias("_word"), F.expr("shiftleft(1L, cast(pmod(shiftright(key, 24), {0}) as int))".format(WORD_BITS)).alias("_bit")


def may_be_candidates(rows: DataFrame, held: DataFrame) -> DataFrame:
    """rows with _may: false only where `key` is not in `held`. The keys set bits of a map of at most MAP_WORDS words, which is
    broadcast, so that texts that are not candidates are told apart where they lie. A full map tells none apart."""
    words = held.select(*_map_place(F.col("key"))).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    placed = rows.select("*", *_map_place(F.col("key"))).join(F.broadcast(words), "_word", "left")
    return placed.withColumn("_may", F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))).drop("_word", "_bit", "_bits")


def _found(text: Column, rule: Rule, order: int) -> Column:
    """Spans (start, order, end) of a rule's matches, in code points: the regex cuts the text into
    pieces and matches in turn, so lengths add up to places."""
    lengths = lambda texts: F.transform(texts, F.length)
    parts = F.struct(
        lengths(F.split(text, rule.pattern, -1)).alias("piece"),
        lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))).alias("match"),
        lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))).alias("value"),
    )

    def spans(p: Column) -> Column:
        steps = F.transform(p["match"], lambda _, i: F.get(p["piece"], i) + F.coalesce(F.get(p["match"], i - 1), F.lit(0)))
        placed = F.transform(running(steps, lambda x, y: x + y), lambda start, i: F.struct(start.alias("start"), F.lit(order).alias("kind"), (start + F.get(p["match"], i)).alias("end")))
        return F.filter(placed, lambda _, i: F.get(p["value"], i) >= max(1, rule.least))

    return let(parts, spans)


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, *, doc_id="doc_id", text="text") -> DataFrame:
    """docs with _spans: array of (start, kind: position in `rules`, end) by start, then kind.

    - null or empty text: no spans. Empty table: empty result. Extra columns stay (one named _spans is replaced)
    - repeated rows and ids: each row is there once with its own text's spans; null ids are ids too
    - matches of one rule do not overlap, leftmost first; those of different rules may, and all are kept
    - very long texts and many secrets: time grows as n log n with a text's secrets
    """
    held = materialize(candidates(docs, rules, doc_id=doc_id, text=text))
    kept = [c for c in docs.columns if c != "_spans"]
    rows = may_be_candidates(docs.select(F.struct(*kept).alias("row"), _key(doc_id, text).alias("key")), held)
    value, empty = F.col("row")[text], F.array().cast(f"array<{SPAN}>")

    def spans(held_rules: Column | None) -> Column:
        """The spans of the rules that a text is to be searched for: those without a trigram query and those held."""
        found = []
        for i, r in enumerate(rules):
            if trigram_query(r.pattern) is None:
                found.append(F.when(value.rlike(r.pattern), _found(value, r, i)).otherwise(empty))
            elif held_rules is not None:
                found.append(F.when(held_rules.bitwiseAND(F.lit(1 << i).cast("bigint")) > 0, _found(value, r, i)).otherwise(empty))
        return F.array_sort(F.concat(*found)) if found else empty

    # Only texts that may be candidates are shuffled, to meet the rules that they are candidates of.
    some = rows.filter("_may").join(held, "key", "left").select("row", spans(F.col("rules")).alias("_spans"))
    rest = rows.filter("not _may").select("row", spans(None).alias("_spans"))
    return some.unionByName(rest).select(*[F.col("row")[c].alias(c) for c in kept], "_spans")


def listed(spans: Column, rules: Sequence[Rule] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by `mask`; null stays null. The text is cut into segments
    once and what is kept is taken from these, since finding a place in a whole text takes as long as the text is."""

    def piece(segments: Column, a: Column, b: Column) -> Column:
        """Code points [a, b)."""
        first = F.floor(a / SEGMENT).cast("int")
        some = F.slice(segments, first + 1, F.floor((b + SEGMENT - 1) / SEGMENT).cast("int") - first)
        within = F.transform(some, lambda x, i: F.substring(x, F.greatest(F.lit(0), a - (first + i) * SEGMENT) + 1, b - F.greatest(a, (first + i) * SEGMENT)))
        return F.when(b > a, F.array_join(within, "")).otherwise("")

    def masked(d: Column) -> Column:
        spans_, tops = d["spans"], d["tops"]
        before = lambda i: F.coalesce(F.get(tops, i - 1), F.lit(0))
        gaps = F.transform(spans_, lambda s, i: F.struct(before(i).alias("a"), s["start"].alias("b"), (s["start"] >= before(i)).alias("new")))
        kept = F.transform(F.filter(gaps, lambda g: g["new"]), lambda g: piece(d["segments"], g["a"], g["b"]))
        return F.array_join(F.concat(kept, F.array(piece(d["segments"], F.element_at(tops, -1), d["n"]))), mask)

    tops = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    given = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0)).alias("segments"), spans.alias("spans"), tops.alias("tops"), F.length(text).alias("n"))
    return F.when(F.size(spans) > 0, let(given, masked)).otherwise(text)
