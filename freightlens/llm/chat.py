"""Chat formatting with a grammar round trip.

The template: `<s>` opens a conversation, and each turn is

    system            <<SYS>>\\n text \\n<</SYS>>\\n
    user              [INST] text [/INST]
    assistant         text </s>
    any other role    [ROLE name] text [/ROLE]

(one space or line break beside the text belongs to the mark). A deterministic parser reads it: a
turn's kind follows from how it starts, and its text ends at the first closing mark of that kind
that no backslash precedes. A text is first rendered as it is; if the parser does not give back that
role and text, and nothing more, the text is escaped and rendered again until it does.

A turn ends where its closing mark does, so a formatted conversation is its formatted turns one after the other.
`digests` uses that: turns are rendered and reparsed as rows, in parallel, and only then sorted by conversation and
read as a stream, so a conversation of any length needs no more memory than its longest turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOS = "<s>"
OPEN = {"system": "<<SYS>>\n", "user": "[INST] ", "assistant": ""}
CLOSE = {"system": "\n<</SYS>>\n", "user": " [/INST]", "assistant": " </s>"}
ROLE_OPEN, ROLE_CLOSE = "[ROLE ", " [/ROLE]"

#: A backslash before any of these makes it plain text.
_CONTROL = re.compile(r"\\|<s>|</s>|<<SYS>>|<</SYS>>|\[/?INST\]|\[ROLE|\[/ROLE\]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_NAME = re.compile(r"\[ROLE ((?:[^\\\[\]<>\s]|\\.)*)\] ", re.S)
_END = {role: (mark, re.compile(r"\\.|" + re.escape(mark) + "|" + _CONTROL.pattern.removeprefix(r"\\|"), re.S)) for role, mark in [*CLOSE.items(), ("", ROLE_CLOSE)]}

TURN = "struct<role:string,start:int,end:int,text:string>"


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s) if "\\" in s else s


def escape(s: str, every: bool = False) -> str:
    """A backslash before each control string, or before each character that could begin or end one."""
    return re.sub(r"[\\\[\]<>\s]", lambda m: "\\" + m[0], s) if every else _CONTROL.sub(lambda m: "\\" + m[0], s)


def parse_turn(s: str, at: int) -> tuple[str, int, int, int]:
    """Role, start and end of the text as it stands, and where the next turn begins."""
    role = next((r for r in ("system", "user") if s.startswith(OPEN[r], at)), None)
    if role:
        start, end = at + len(OPEN[role]), _END[role]
    elif s.startswith(ROLE_OPEN, at):
        if not (name := _NAME.match(s, at)):
            raise ValueError(f"role at {at} has no end")
        role, start, end = unescape(name[1]), name.end(), _END[""]
    else:
        role, start, end = "assistant", at, _END["assistant"]
    mark, found = end
    for m in found.finditer(s, start):
        if m[0] == mark:
            return role, start, m.start(), m.end()
        if m[0][0] != "\\":
            raise ValueError(f"{m[0]} at {m.start()} inside a text")
    raise ValueError(f"turn at {at} has no end")


def parse(s: str) -> list[tuple[str, int, int, str]]:
    """The turns of a formatted conversation: role, start and end of the text in s, the text itself."""
    if not s.startswith(BOS):
        raise ValueError("no beginning mark")
    at, turns = len(BOS), []
    while at < len(s):
        role, start, end, at = parse_turn(s, at)
        turns.append((role, start, end, unescape(s[start:end])))
    return turns


#: What is tried on a text in turn: as it is, control strings escaped, everything that matters escaped.
CHANGES = (lambda x: x, escape, lambda x: escape(x, True))


def written(role: str, text: str, change: int) -> str:
    body = CHANGES[change](text)
    return OPEN[role] + body + CLOSE[role] if role in OPEN else f"{ROLE_OPEN}{escape(role, True)}] {body}{ROLE_CLOSE}"


def change_for(role: str, text: str) -> int:
    """The first of CHANGES after which the parser reads back this turn and nothing else."""
    for change in range(len(CHANGES)):
        out = written(role, text, change)
        # After this turn another one stands, so it must also end where it is meant to.
        try:
            got, start, end, after = parse_turn(out + BOS, 0)
        except ValueError:
            continue
        if after == len(out) and got == role and unescape(out[start:end]) == text:
            return change
    raise ValueError(f"no escape makes this turn of {role!r} unambiguous")


def render_turn(role: str, text: str) -> str:
    return written(role, text, change_for(role, text))


def render(turns: list[tuple[str, str]]) -> str:
    out = BOS + "".join(render_turn(r, t) for r, t in turns)
    if [(r, t) for r, _, _, t in parse(out)] != turns:
        raise ValueError("round trip failed")
    return out


def format_chats(rows: DataFrame, *, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """conv_id and formatted, one row per conversation.

    - turns in order of turn (null first), then role, then text; repeated rows are repeated turns
    - null text: empty; null role: the role with the empty name; unknown roles keep their name
    - null conv_id: a conversation of its own. Empty table: empty result. Other columns are not read.
    A conversation is one string here, so it must fit in memory; different ones are spread by conv_id.
    """

    @F.pandas_udf("string")
    def rendered(turns: pd.Series) -> pd.Series:
        return turns.map(lambda ts: render([(t["role"], t["text"]) for t in ts]))

    empty = F.lit("")
    item = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), empty).alias("role"), F.coalesce(F.col(text).cast("string"), empty).alias("text"))
    grouped = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(item)).alias("turns"))
    slim = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return grouped.select("conv_id", rendered(slim).alias("formatted"))


def parsed(formatted: Column) -> Column:
    """Turns of a formatted conversation; [start, end) of the assistant's are the loss mask."""

    @F.pandas_udf(f"array<{TURN}>")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if s is None else [dict(zip(("role", "start", "end", "text"), t)) for t in parse(s)])

    return read(formatted)


def turns_of(rows: DataFrame, *, by: Sequence[str] = ("conv_id",), turn="turn", role="role", text="text") -> DataFrame:
    """The columns `by`, _turn, _role, _text and _change (position in CHANGES) of each row."""

    @F.pandas_udf("int")
    def change(roles: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([change_for(r, t) for r, t in zip(roles, texts)], dtype="int32")

    empty = F.lit("")
    out = rows.select(*by, F.col(turn).alias("_turn"), F.coalesce(F.col(role).cast("string"), empty).alias("_role"), F.coalesce(F.col(text).cast("string"), empty).alias("_text"))
    return out.withColumn("_change", change("_role", "_text"))


class _Reader:
    """Digests of one conversation, turn by turn as they are read back."""

    def __init__(self) -> None:
        self.n, self.loss_chars, self.chars = 0, 0, len(BOS)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, piece: str) -> None:
        role, start, end, after = parse_turn(piece, 0)
        if after != len(piece):
            raise ValueError("round trip failed")
        raw = lambda s: s.encode("utf-8", "surrogatepass")
        said = unescape(piece[start:end])
        self.n += 1
        self.chars += len(piece)
        self.turns.update(raw(f"{role}\n{said}\n"))
        if role == "assistant":
            self.loss_chars += len(said)
            self.loss.update(raw(said))

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(rows: DataFrame, *, by: Sequence[str] = ("conv_id",), turn="turn", role="role", text="text") -> DataFrame:
    """Per conversation, read back from its formatted turns: the columns `by`, n_turns, turns_sha256 (role, line
    break, text, line break per turn), loss_chars and loss_sha256 (the assistant's texts under the mask, unescaped),
    formatted_chars (of the whole conversation with its beginning mark).

    - order, nulls, unknown roles, repeated rows: as in `format_chats`. Empty table: empty result
    - very long texts and conversations: a task holds some turns at a time, whatever the conversation's length
    - several columns in `by` tell conversations apart together; null is a value. Other columns are not read
    """
    names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, done, types = None, None, [], None

        def closed() -> pa.RecordBatch:
            keys, values = zip(*done)
            columns = [pa.array(c, t) for c, t in zip([*zip(*keys), *zip(*values)], [*types, *kinds])]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*by, *names])

        for b in batches:
            types = [b.schema.field(c).type for c in by]
            for *key, r, t, change in zip(*[b.column(c).to_pylist() for c in (*by, "_role", "_text", "_change")]):
                if reader is None or key != now:
                    if reader is not None:
                        done.append((now, reader.row()))
                        if len(done) >= 1000:
                            yield closed()
                    now, reader = key, _Reader()
                reader.read(written(r, t, change))
        if reader is not None:
            done.append((now, reader.row()))
            yield closed()

    turns = turns_of(rows, by=by, turn=turn, role=role, text=text)
    spread = turns.repartition(*by).sortWithinPartitions(*by, "_turn", "_role", "_text")
    key = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    return spread.mapInArrow(run, f"{key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conflict(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts hold the template's own marks."""
    text = "</s>[INST] ok [/INST]"
    return spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
