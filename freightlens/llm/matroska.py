"""Media columns: Matroska files as binary columns, and packet tables read from them.

`write` lays bytes out as 8-bit PCM in an EBML file: header, segment, track, clusters of laced blocks,
cues. `parse` reads any such file by its EBML structure alone: variable-length ids and sizes, unknown
sizes, SimpleBlock and BlockGroup, all four lacings, cues. It gives one packet per frame with track,
time and byte range, so a reader can fetch frames without the rest of the file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAME = 576
RATE = 48_000
FRAMES_A_BLOCK = 8
BLOCKS_A_CLUSTER = 16

# Fixed values of the Matroska and EBML formats: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, DEFAULT_DURATION, CODEC = 0x2AD7B1, 0xAE, 0xD7, 0x23E383, 0x86
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
LACINGS = ("none", "xiph", "fixed", "ebml")

PACKET = "struct<track:int,timestamp_ns:bigint,cluster:int,lacing:string,offset:bigint,size:bigint,key:boolean>"
FILE = f"struct<error:string,codec:string,n_clusters:int,n_cues:int,cues_ok:boolean,packets:array<{PACKET}>>"


def _id(i: int) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big")


def _size(n: int, width: int = 0) -> bytes:
    """A size as a variable-length number; all ones would mean unknown."""
    while not width or n > (1 << 7 * width) - 2:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(i: int, body: bytes) -> bytes:
    return _id(i) + _size(len(body)) + body


def _uint(i: int, n: int) -> bytes:
    return _element(i, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes], kind: int) -> bytes:
    """The lace header for all frames but the last, whose size is what is left of the block."""
    sizes = [len(f) for f in frames]
    head = b"" if kind == 0 else bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 3:
        head += _size(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = 1
            while not abs(b - a) < (1 << 7 * width - 1) - 1:
                width += 1
            head += _size(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def write(payload: bytes, frame: int = FRAME, rate: int = RATE) -> bytes:
    """A Matroska file whose frames in order are `payload`. Blocks take the lacings in turn; every
    second block is a BlockGroup. The timestamp unit is one frame."""
    tick = frame * 1_000_000_000 // rate
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    blocks, at = [], 0
    while at < len(frames):
        kind = len(blocks) % 4
        take = min(1 if kind == 0 else FRAMES_A_BLOCK, len(frames) - at)
        lace = frames[at : at + take]
        kind = 0 if take == 1 or (kind == 2 and len({len(f) for f in lace}) > 1) else kind
        if kind == 0:
            take, lace = 1, lace[:1]
        blocks.append((at, kind, lace))
        at += take
    head = _element(EBML, _element(0x4282, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
    info = _element(INFO, _uint(TIMESTAMP_SCALE, tick) + _element(0x4D80, b"freightlens") + _element(0x5741, b"freightlens"))
    audio = _element(0xE1, _element(0xB5, struct.pack(">d", rate)) + _uint(0x9F, 1) + _uint(0x6264, 8))
    entry = _uint(TRACK_NUMBER, 1) + _uint(0x73C5, 1) + _uint(0x83, 2) + _uint(DEFAULT_DURATION, tick) + _element(CODEC, b"A_PCM/INT/LIT") + audio
    tracks = _element(TRACKS, _element(TRACK_ENTRY, entry))
    clusters, cues, where = [], [], len(info) + len(tracks)
    for c in range(0, len(blocks), BLOCKS_A_CLUSTER):
        first = blocks[c][0]
        body = [_uint(TIMESTAMP, first)]
        for k, (start, kind, lace) in enumerate(blocks[c : c + BLOCKS_A_CLUSTER]):
            grouped = k % 2
            raw = b"\x81" + struct.pack(">hB", start - first, kind << 1 | (0 if grouped else 0x80)) + _lace(lace, kind)
            body.append(_element(BLOCK_GROUP, _element(BLOCK, raw)) if grouped else _element(SIMPLE_BLOCK, raw))
        clusters.append(_element(CLUSTER, b"".join(body)))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, first) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, where))))
        where += len(clusters[-1])
    return head + _element(SEGMENT, b"".join([info, tracks, *clusters, _element(CUES, b"".join(cues))]))


def _number(data: bytes, at: int, end: int, keep: bool = False) -> tuple[int | None, int, int]:
    """The variable-length number at `at`, the place after it, its width. keep: with the length mark,
    as in ids. None: unknown size."""
    if at >= end or not data[at]:
        raise ValueError(f"no number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"number cut off at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if keep:
        return n, at + width, width
    n ^= 1 << 7 * width
    return (None if n == (1 << 7 * width) - 1 else n), at + width, width


def _elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """id, start and end of each element's body. A cluster of unknown size ends where an element begins that is no
    child of a cluster, any other element of unknown size with what holds it."""
    while at < end:
        i, body, _ = _number(data, at, end, keep=True)
        n, body, _ = _number(data, body, end)
        if n is None:
            stop = body
            if i == CLUSTER:
                while stop < end:
                    child, x, _ = _number(data, stop, end, keep=True)
                    if child in (CLUSTER, CUES, INFO, TRACKS, EBML, SEGMENT):
                        break
                    m, x, _ = _number(data, x, end)
                    stop = end if m is None else x + m
            else:
                stop = end
        else:
            stop = body + n
        if stop > end:
            raise ValueError(f"element {i:x} cut off")
        yield i, body, stop
        at = stop


def _block(data: bytes, at: int, end: int, now: int, key: bool | None, tick: int, frame_ns: dict[int, int], cluster: int) -> list[tuple]:
    track, at, _ = _number(data, at, end)
    if track is None or at + 3 > end:
        raise ValueError("block cut off")
    offset, flags = struct.unpack_from(">hB", data, at)
    at, kind = at + 3, flags >> 1 & 3
    sizes: list[int] = []
    if kind:
        if at >= end:
            raise ValueError("lace cut off")
        more, at = data[at], at + 1
        if kind == 1:
            for _ in range(more):
                n = 0
                while at < end and data[at] == 255:
                    n, at = n + 255, at + 1
                if at >= end:
                    raise ValueError("lace cut off")
                sizes.append(n + data[at])
                at += 1
        elif kind == 3 and more:
            n, at, _ = _number(data, at, end)
            sizes.append(n or 0)
            for _ in range(more - 1):
                d, at, width = _number(data, at, end)
                d = (1 << 7 * width) - 1 if d is None else d
                sizes.append(sizes[-1] + d - ((1 << 7 * width - 1) - 1))
        elif kind == 2:
            if (end - at) % (more + 1):
                raise ValueError("fixed lace of uneven size")
            sizes = [(end - at) // (more + 1)] * more
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lace larger than its block")
    start, step, out = (now + offset) * tick, frame_ns.get(track, 0), []
    for k, n in enumerate(sizes):
        out.append((track, start + k * step, cluster, LACINGS[kind], at, n, bool(flags & 0x80) if key is None else key))
        at += n
    return out


def parse(data: bytes | None) -> dict | None:
    """What FILE describes. A damaged file gives its error and no packets; null gives null."""
    if data is None:
        return None
    out = {"error": None, "codec": None, "n_clusters": 0, "n_cues": 0, "cues_ok": True, "packets": []}
    uint = lambda a, b: int.from_bytes(data[a:b], "big")
    try:
        tops = list(_elements(data, 0, len(data)))
        if not tops or tops[0][0] != EBML:
            raise ValueError("no EBML header")
        base, end = next(((a, b) for i, a, b in tops if i == SEGMENT), (0, 0))
        tick, frame_ns, starts, cues = 1_000_000, {}, {}, []
        for i, a, b in _elements(data, base, end):
            if i == INFO:
                tick = next((uint(x, y) for j, x, y in _elements(data, a, b) if j == TIMESTAMP_SCALE), tick)
            elif i == TRACKS:
                for _, x, y in _elements(data, a, b):
                    fields = {j: (p, q) for j, p, q in _elements(data, x, y)}
                    if TRACK_NUMBER in fields:
                        frame_ns[uint(*fields[TRACK_NUMBER])] = uint(*fields[DEFAULT_DURATION]) if DEFAULT_DURATION in fields else 0
                    if CODEC in fields and out["codec"] is None:
                        out["codec"] = data[slice(*fields[CODEC])].decode("ascii", "replace")
            elif i == CLUSTER:
                now, number = 0, out["n_clusters"]
                out["n_clusters"] += 1
                for j, x, y in _elements(data, a, b):
                    if j == TIMESTAMP:
                        now = uint(x, y)
                        starts[now] = a
                    elif j == SIMPLE_BLOCK:
                        out["packets"] += _block(data, x, y, now, None, tick, frame_ns, number)
                    elif j == BLOCK_GROUP:
                        group = {k: (p, q) for k, p, q in _elements(data, x, y)}
                        if BLOCK in group:
                            out["packets"] += _block(data, *group[BLOCK], now, 0xFB not in group, tick, frame_ns, number)
            elif i == CUES:
                for _, x, y in _elements(data, a, b):
                    point = {j: (p, q) for j, p, q in _elements(data, x, y)}
                    place = {j: (p, q) for j, p, q in _elements(data, *point[CUE_POSITIONS])}
                    cues.append((uint(*point[CUE_TIME]), base + uint(*place[CUE_CLUSTER])))
        out["n_cues"] = len(cues)
        for time, at in cues:  # a cue is right if the cluster of its time begins where it points
            i, body, _ = _number(data, at, end, keep=True)
            _, body, _ = _number(data, body, end)
            out["cues_ok"] &= i == CLUSTER and starts.get(time) == body
    except (ValueError, KeyError, IndexError, struct.error, StopIteration) as e:
        out |= {"error": str(e) or type(e).__name__, "packets": []}
    return out


def padded(text: str | None, unit: int = FRAME) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % unit if raw else unit)


def with_media(docs: DataFrame, *, text: str = "text", out: str = "media") -> DataFrame:
    """docs with a Matroska file of each whole text in column `out` (replaced if there).

    - null or empty text: one frame of padding. Equal texts, repeated rows and ties: equal files
    - very long texts: one file each, as long as the text and some bytes a block; nothing is cut off
    - extra columns stay. Empty table: empty result"""

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: write(padded(t)), na_action=None)

    return docs.withColumn(out, encode(F.col(text)))


def parsed(media: Column) -> Column:
    """The FILE structure of a binary column."""

    @F.pandas_udf(FILE)
    def read(files: pd.Series) -> pd.DataFrame:
        names = ("error", "codec", "n_clusters", "n_cues", "cues_ok", "packets")
        keys = ("track", "timestamp_ns", "cluster", "lacing", "offset", "size", "key")
        got = [parse(x) or {} for x in files]
        return pd.DataFrame({n: [[dict(zip(keys, p)) for p in g.get(n, [])] if n == "packets" else g.get(n) for g in got] for n in names})

    return read(media)


def packet_table(media: DataFrame, *, doc_id: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per frame: doc_id, packet (from 0), track, timestamp_ns, cluster, lacing, offset, size,
    key. Null, empty or damaged files have no rows."""
    rows = media.select(F.col(doc_id).alias("doc_id"), parsed(F.col(column)).alias("_f"))
    return rows.select("doc_id", F.posexplode("_f.packets").alias("packet", "_p")).select("doc_id", "packet", "_p.*")


def digests(media: DataFrame, *, doc_id: str = "doc_id", column: str = "media") -> DataFrame:
    """Per file, from the stored bytes alone: payload_bytes, payload_sha256, tail_crc32 (of the last
    32 payload bytes), media_bytes, media_sha256, feature. The payload is cut from the file by the
    packets' byte ranges. A null or damaged file has null payload columns and its error as feature."""
    schema = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [c.split()[0] for c in schema.split(", ")]

    @F.pandas_udf(f"struct<{', '.join(c.replace(' ', ':') for c in schema.split(', '))}>")
    def digest(files: pd.Series) -> pd.DataFrame:
        rows = []
        for data in files:
            f = parse(data)
            if f is None or f["error"] is not None:
                rows.append((None, None, None, len(data) if data else 0, hashlib.sha256(data or b"").hexdigest(), f and f["error"]))
                continue
            packets = f["packets"]
            payload = b"".join([data[p[4] : p[4] + p[5]] for p in packets])
            laced = {k: 0 for k in LACINGS}
            for p in packets:
                laced[p[3]] += 1
            mean = sum(payload) / len(payload) if payload else 0.0
            feature = f"{f['codec']};packets={len(packets)};clusters={f['n_clusters']};cues={f['n_cues']}{'' if f['cues_ok'] else '!'};last_ns={packets[-1][1] if packets else 0};lacing={','.join(f'{k}:{v}' for k, v in laced.items())};mean={mean:.4f}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
        return pd.DataFrame(rows, columns=names)

    return media.withColumn("_d", digest(F.col(column))).select(F.col(doc_id).alias("doc_id"), "_d.*")
