"""Files written and read again; files as other writers make them; damage."""

import hashlib
import random
import struct
import zlib

from freightlens.llm import matroska as m
from freightlens.llm.queries import QUERIES


def payload(data, parsed):
    return b"".join(data[p[4] : p[4] + p[5]] for p in parsed["packets"])


def test_round_trip_of_any_bytes():
    rng = random.Random(4)
    for n in (1, 575, 576, 577, 5000, 200_000):
        raw = rng.randbytes(n)
        data = m.write(raw)
        f = m.parse(data)
        assert f["error"] is None and f["cues_ok"] and payload(data, f) == raw
        assert f["n_cues"] == f["n_clusters"] > 0
        times = [p[1] for p in f["packets"]]
        assert times == [12_000_000 * i for i in range(len(times))]
    assert {p[3] for p in m.parse(m.write(bytes(100_000)))["packets"]} == set(m.LACINGS)


def test_lacings_of_uneven_frames():
    frames = [b"a" * 3, b"b" * 700, b"c" * 255, b"d" * 20, b"e"]
    for kind in (1, 3):
        block = b"\x81" + struct.pack(">hB", -2, kind << 1) + m._lace(frames, kind)
        got = m._block(block, 0, len(block), 10, None, 1000, {1: 5}, 0)
        assert [block[p[4] : p[4] + p[5]] for p in got] == frames
        assert [p[1] for p in got] == [8000 + 5 * i for i in range(5)]


def test_unknown_sizes_and_foreign_elements():
    block = m._element(m.SIMPLE_BLOCK, b"\x82" + struct.pack(">hB", 7, 0x80) + b"data")
    cluster = m._id(m.CLUSTER) + b"\x01" + b"\xff" * 7 + m._uint(m.TIMESTAMP, 100) + m._element(0xEC, b"void") + block
    data = m._element(m.EBML, b"") + m._id(m.SEGMENT) + b"\xff" + m._element(m.INFO, b"") + cluster + cluster + m._element(0xEC, b"")
    f = m.parse(data)
    assert f["error"] is None and f["n_clusters"] == 2
    assert [(p[0], p[1], p[2], p[6]) for p in f["packets"]] == [(2, 107_000_000, 0, True), (2, 107_000_000, 1, True)]
    assert payload(data, f) == b"datadata"


def test_damage_is_told():
    data = m.write(bytes(3000))
    for bad in (b"", b"\x00", b"text", data[:-5], data[:60], data[:200] + b"\x00" * 50 + data[250:-9]):
        f = m.parse(bad)
        assert f["packets"] == [] and f["error"] or payload(bad, f) is not None
    assert m.parse(None) is None


def test_columns(spark):
    rows = [(1, "é" * 700, "x"), (2, None, "x"), (2, "", "x"), (None, "b" * 576, "x"), (3, "b" * 576, "x"), (4, "long " * 100_000, "x")]
    media = m.with_media(spark.createDataFrame(rows, "doc_id long, text string, media string"))
    out = sorted((tuple(r) for r in m.digests(media).collect()), key=str)
    assert len(out) == 6
    for doc, text, _ in rows:
        raw = (text or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        mine = [r for r in out if r[0] == doc and r[1] == len(full) and r[2] == hashlib.sha256(full).hexdigest()]
        assert mine and mine[0][3] == zlib.crc32(full[-32:])
    packets = m.packet_table(media).collect()
    assert sum(p.size for p in packets) == sum(r[1] for r in out)
    assert m.digests(m.with_media(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"no"))], "doc_id long, media binary")
    assert [r.payload_bytes for r in m.digests(broken).collect()] == [None, None] and m.packet_table(broken).count() == 0


def test_whole_table(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = QUERIES["op2_matroska"](spark, "/root/testdata/sf0.01").collect()
    assert len(out) == len(rows)
    for r in out:
        raw = (rows[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        media = m.write(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
