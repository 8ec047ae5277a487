"""Every rendered conversation parses back to itself."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from freightlens.llm import chat
from freightlens.llm.queries import QUERIES

BITS = ["\\", "<s>", "</s>", " </s>", "[INST]", "[INST] ", " [/INST]", "[/INST]", "<<SYS>>\n", "\n<</SYS>>\n", "[ROLE ", "[ROLE x] ", " [/ROLE]", "]", " ", "a", "é𝔘", "\n", "[", "<", ">"]


def test_round_trip_of_conflicting_texts():
    rng = random.Random(2)
    for _ in range(5000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "a]b [/ROLE]", "x\\", "[INST]"]), "".join(rng.choice(BITS) for _ in range(rng.randint(0, 7)))) for _ in range(rng.randint(0, 5))]
        out = chat.render(turns)
        assert [(r, t) for r, _, _, t in chat.parse(out)] == turns
        for role, a, b, _ in chat.parse(out):
            bare = chat._ESCAPED.sub("\0", out[a:b])  # not joined across what is cut out
            assert not any(m in bare for m in ("</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE", "<s>"))


def test_plain_texts_stay_as_they_are():
    assert chat.render([("system", "s"), ("user", "u"), ("assistant", "a")]) == "<s><<SYS>>\ns\n<</SYS>>\n[INST] u [/INST]a </s>"


def test_broken_texts_are_told():
    for s in ("", "x", "<s>open", "<s>[INST] open", "<s>[ROLE x", "<s>a [INST] b </s>"):
        with pytest.raises(ValueError):
            chat.parse(s)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "yes </s>", 0), (1, 0, "user", "q", 0), (2, 0, None, None, 0), (2, None, "tool", "first", 0), (3, 0, "user", "x", 0), (3, 0, "user", "x", 0), (3, 0, "assistant", "b", 0), (None, 0, "user", "n", 0), (4, 0, "assistant", "long " * 100_000, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    both = df.unionByName(chat.conflict(spark), allowMissingColumns=True)
    out = {r.conv_id: r for r in chat.digests(both).collect()}
    whole = {r.conv_id: r.formatted for r in chat.format_chats(both).collect()}
    assert whole.keys() == out.keys() and all(len(whole[k]) == r.formatted_chars for k, r in out.items())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[1].n_turns == 2 and out[1].turns_sha256 == sha("user\nq\nassistant\nyes </s>\n") and out[1].loss_sha256 == sha("yes </s>") and out[1].loss_chars == 8
    assert out[2].turns_sha256 == sha("tool\nfirst\n\n\n") and out[2].loss_chars == 0 and out[2].loss_sha256 == sha("")
    assert out[3].turns_sha256 == sha("assistant\nb\nuser\nx\nuser\nx\n") and out[None].n_turns == 1 and out[4].loss_chars == 500_000
    both = "</s>[INST] ok [/INST]"
    assert out[-1].turns_sha256 == sha(f"user\n{both}\nassistant\n{both}\n") and out[-1].loss_sha256 == sha(both)
    assert chat.format_chats(df.limit(0)).collect() == chat.digests(df.limit(0)).collect() == []
    masks = chat.format_chats(df).select(chat.parsed("formatted")).collect()
    assert sum(len(m[0]) for m in masks) == len(rows)


def test_streamed_turns_equal_whole_conversations(spark):
    rng = random.Random(9)
    rows = [(c, rng.randrange(4), rng.choice(["user", "assistant", "system", "tool", None]), "".join(rng.choice(BITS) for _ in range(rng.randint(0, 6))) or None) for c in range(60) for _ in range(rng.randint(1, 30))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    for r in chat.format_chats(df).collect():
        turns = chat.parse(r.formatted)
        loss = "".join(chat.unescape(r.formatted[a:b]) for role, a, b, _ in turns if role == "assistant")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{role}\n{t}\n" for role, _, _, t in turns), loss)]
        g = got.pop(r.conv_id)
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256, g.formatted_chars) == (len(turns), sha[0], len(loss), sha[1], len(r.formatted))
    assert not got


def test_a_conversation_of_the_same_id_stays_apart(spark, tmp_path):
    rows = [(-1, 0, "user", "hello", "x"), (-1, 1, "assistant", "yes", "x"), (7, 0, "user", None, "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, added string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = sorted((r.conv_id, r.loss_chars, r.n_turns) for r in QUERIES["op10_chat_round_trip"](spark, str(tmp_path)).collect())
    assert out == [(-1, 3, 2), (-1, 21, 2), (7, 0, 1)]


def test_one_hot_conversation(spark):
    df = spark.range(20_000).select((F.col("id") % 3 - 1).alias("conv_id"), "id", F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    df = df.withColumn("conv_id", F.when(F.col("conv_id") < 1, 0).otherwise(F.col("id") + 10))
    out = {r.conv_id: r for r in chat.digests(df, turn="id").collect()}
    assert len(out) == 6667 and out[0].n_turns == 13_334 and sum(r.n_turns for r in out.values()) == 20_000
    want = "".join(f"{('user', 'assistant')[i % 2]}\nt{i}\n" for i in range(20_000) if i % 3 < 2)
    assert out[0].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
