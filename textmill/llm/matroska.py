"""Matroska media columns: EBML writing, and parsing into packet tables.

Elements have variable-length ids and sizes. The parser walks the segment,
clusters and block groups, undoes Xiph, EBML and fixed-size lacing, takes
clusters of unknown size, and reads the cues; packets carry track, timestamp in
nanoseconds and their byte range in the file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.shared import by_arrow, rows_out

# Element ids of EBML and Matroska.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, SCALE, ENTRY, NUMBER, KIND, CODEC = 0x4282, 0x2AD7B1, 0xAE, 0xD7, 0x83, 0x86
AUDIO, RATE, CHANNELS, DEPTH, DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
TIME, SIMPLE, GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
POINT, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

FRAME = 576
RATE_HZ = 8000
LACED = 8
PER_CLUSTER = 256


def size_field(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer, of ``width`` bytes if given."""
    width = width or next(w for w in range(1, 9) if n < (1 << (7 * w)) - 1)
    return ((1 << (7 * width)) | n).to_bytes(width, "big")


def element(ident: int, data: bytes) -> bytes:
    """One element."""
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_field(len(data)) + data


def uint(ident: int, n: int) -> bytes:
    """An unsigned element."""
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def mux(payload: bytes) -> bytes:
    """8-bit mono PCM in frames of ``FRAME`` samples, laced at fixed size, with cues to every cluster."""
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    info = element(INFO, uint(SCALE, 1_000_000))
    audio = element(AUDIO, element(RATE, struct.pack(">d", RATE_HZ)) + uint(CHANNELS, 1) + uint(DEPTH, 8))
    tracks = element(TRACKS, element(ENTRY, uint(NUMBER, 1) + uint(KIND, 2) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    body, at, cues = [info, tracks], len(info) + len(tracks), []
    frames = len(payload) // FRAME
    for first in range(0, frames, PER_CLUSTER):
        start = first * FRAME * 1000 // RATE_HZ
        blocks = [uint(TIME, start)]
        for f in range(first, min(first + PER_CLUSTER, frames), LACED):
            n = min(LACED, first + PER_CLUSTER - f, frames - f)
            flags = b"\x84" + bytes([n - 1]) if n > 1 else b"\x80"
            blocks.append(element(SIMPLE, b"\x81" + struct.pack(">h", f * FRAME * 1000 // RATE_HZ - start) + flags + payload[f * FRAME : (f + n) * FRAME]))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(POINT, uint(CUE_TIME, start) + element(CUE_PLACE, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


@dataclass
class Media:
    """What a file holds: packets (track, timestamp ns, offset, size, key frame), cues (time ns, track, offset) and track codecs."""

    packets: list[tuple[int, int, int, int, bool]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    codecs: dict[int, str] = field(default_factory=dict)
    clusters: int = 0
    frame_ns: dict[int, int] = field(default_factory=dict)  # default duration of a track's frames
    byte_ns: dict[int, float] = field(default_factory=dict)  # of a byte of uncompressed sound
    places: list[int] = field(default_factory=list)  # of the clusters in the segment


def _vint(data: bytes, at: int, keep: bool) -> tuple[int, int, bool]:
    """Value of a variable-length integer, the place behind it, whether it means unknown."""
    if at >= len(data) or not data[at]:
        raise ValueError("not an EBML integer")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError("cut off within an EBML integer")
    n = int.from_bytes(data[at : at + width], "big")
    bare = n & ((1 << (7 * width)) - 1)
    return n if keep else bare, at + width, bare == (1 << (7 * width)) - 1


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start of the data, its end) of each element; one of unknown size reaches to ``end`` or the next cluster or cues."""
    while at < end:
        ident, at, _ = _vint(data, at, True)
        n, at, unknown = _vint(data, at, False)
        if unknown and ident == CLUSTER:
            stop = at
            while stop < end:
                inner, behind, _ = _vint(data, stop, True)
                if inner in (CLUSTER, CUES, TRACKS, INFO):
                    break
                size, behind, _ = _vint(data, behind, False)
                stop = behind + size
        else:
            stop = end if unknown else at + n
        if stop > end:
            raise ValueError("an element reaches beyond what holds it")
        yield ident, at, stop
        at = stop


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def laces(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a block's payload: kind 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if not kind:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        if (end - at) % n:
            raise ValueError("a fixed-size lace that doesn't divide")
        sizes = [(end - at) // n] * (n - 1)
    elif kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif n > 1:
        size, at, _ = _vint(data, at, False)
        sizes.append(size)
        for _ in range(n - 2):
            before = at
            delta, at, _ = _vint(data, at, False)
            sizes.append(sizes[-1] + delta - ((1 << (7 * (at - before) - 1)) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laces longer than their block")
    out = []
    for s in sizes:
        out.append((at, s))
        at += s
    return out


def parse(data: bytes) -> Media:
    """Tables of a Matroska file. ValueError for damaged files, those without a segment, and cues that name no cluster."""
    try:
        if all(i != SEGMENT for i, _, _ in elements(data, 0, len(data))):
            raise ValueError("no segment")
        return _parse(data)
    except (IndexError, struct.error) as e:
        raise ValueError("cut off within an element") from e


def _real(data: bytes, a: int, b: int) -> float:
    """An element of floating point, of four or eight bytes."""
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0


def _parse(data: bytes) -> Media:
    out, scale = Media(), 1_000_000
    for ident, a, b in elements(data, 0, len(data)):
        if ident != SEGMENT:
            continue
        base = at = a
        for kind, c, d in elements(data, a, b):
            if kind == INFO:
                scale = next((_number(data, x, y) for i, x, y in elements(data, c, d) if i == SCALE), scale)
            elif kind == TRACKS:
                for i, e, f in elements(data, c, d):
                    if i == ENTRY:
                        _track(data, e, f, out)
            elif kind == CLUSTER:
                out.clusters += 1
                out.places.append(at)
                start = 0
                for i, x, y in elements(data, c, d):
                    if i == TIME:
                        start = _number(data, x, y)
                    elif i == SIMPLE:
                        _block(data, x, y, start, scale, out, bool(data[_vint(data, x, False)[1] + 2] & 0x80))
                    elif i == GROUP:
                        inner = {j: (v, w) for j, v, w in elements(data, x, y)}
                        if BLOCK in inner:
                            # a group without references stands alone
                            _block(data, *inner[BLOCK], start, scale, out, REFERENCE not in inner)
            elif kind == CUES:
                for _, e, f in elements(data, c, d):
                    time = 0
                    for i, x, y in elements(data, e, f):
                        if i == CUE_TIME:
                            time = _number(data, x, y)
                        elif i == CUE_PLACE:
                            got = {j: _number(data, v, w) for j, v, w in elements(data, x, y)}
                            out.cues.append((time * scale, got.get(CUE_TRACK, 0), base + got.get(CUE_CLUSTER, 0)))
            at = d
    if not {place for _, _, place in out.cues} <= set(out.places):
        raise ValueError("a cue names no cluster")
    return out


def _track(data: bytes, a: int, b: int, out: Media) -> None:
    """Codec of a track, and what gives its laced frames their times: the default duration, or rate, channels and depth of uncompressed sound."""
    got = {i: (x, y) for i, x, y in elements(data, a, b)}
    if NUMBER not in got or CODEC not in got:
        return
    n = _number(data, *got[NUMBER])
    out.codecs[n] = data[slice(*got[CODEC])].decode("ascii", "replace")
    if DURATION in got:
        out.frame_ns[n] = _number(data, *got[DURATION])
    elif AUDIO in got and out.codecs[n].startswith("A_PCM"):
        audio = {i: (x, y) for i, x, y in elements(data, *got[AUDIO])}
        rate = _real(data, *audio[RATE]) if RATE in audio else 8000.0
        channels, depth = (_number(data, *audio[i]) if i in audio else d for i, d in ((CHANNELS, 1), (DEPTH, 8)))
        if rate > 0 and channels and depth:
            out.byte_ns[n] = 8e9 / (rate * channels * depth)


def _block(data: bytes, at: int, end: int, start: int, scale: int, out: Media, key: bool) -> None:
    """Packets of a block. Later frames of a lace follow by their track's times; where it states none they have the block's."""
    track, at, _ = _vint(data, at, False)
    (shift,), flags = struct.unpack_from(">h", data, at), data[at + 2]
    time = (start + shift) * scale
    for offset, size in laces(data, at + 3, end, flags >> 1 & 3):
        out.packets.append((track, time, offset, size, key))
        time += out.frame_ns.get(track) or int(size * out.byte_ns.get(track, 0))


def padded(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 filled with bytes 255 to a positive multiple of the frame, and its length before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw)), len(raw)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a Matroska file. Null and empty texts are one frame of filling; rows keep their number."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [padded(t) for t in b.column(1).to_pylist()]
            yield rows_out({"doc_id": (pa.int64(), b.column(0).to_pylist()), "n_bytes": (pa.int64(), [n for _, n in made]), "media": (pa.binary(), [mux(p) for p, _ in made])})

    return by_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), f, "doc_id long, n_bytes long, media binary", rows=64)


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet: doc_id, track, codec, timestamp_ns, offset, size, key_frame, cued (its cluster is in the cues). Null media give none; damaged files raise."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                m = parse(data) if data is not None else Media()
                cued = {(t, time) for time, t, _ in m.cues}
                rows += [(doc, t, m.codecs.get(t), time, o, n, k, (t, time) in cued) for t, time, o, n, k in m.packets]
            cols = list(zip(*rows)) or [()] * 8
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            yield rows_out({c: (t, list(v)) for c, t, v in zip(("doc_id", "track", "codec", "timestamp_ns", "offset", "size", "key_frame", "cued"), types, cols)})

    return by_arrow(media.select(F.col(id_col).cast("long"), F.col(media_col)), f, "doc_id long, track long, codec string, timestamp_ns long, offset long, size long, key_frame boolean, cued boolean", rows=64)


def media_digests(media: DataFrame) -> DataFrame:
    """Per row of ``media_column``: what its file gives when it is read back, with a feature string of packets, clusters, cues, duration (-1 without packets) and sample moments. Null media give nulls; damaged files raise."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, n, data in zip(*(c.to_pylist() for c in b.columns)):
                if data is None:
                    rows.append((doc, n, *[None] * 6))
                    continue
                m = parse(data)
                payload = b"".join([data[o : o + s] for _, _, o, s, _ in m.packets])
                x = np.frombuffer(payload, np.uint8).astype(np.int64)
                crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
                feature = f"packets={len(m.packets)};clusters={m.clusters};cues={len(m.cues)};last_ns={m.packets[-1][1] if m.packets else -1};sum={int(x.sum())};squares={int((x * x).sum())};crossings={crossings}"
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = list(zip(*rows)) or [()] * 8
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield rows_out({c: (t, list(v)) for c, t, v in zip(("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"), types, cols)})

    return by_arrow(media, f, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", rows=64)
