from __future__ import annotations

import base64
import hashlib
import random
import struct
import zlib

import pytest

from textmill.llm.matroska import AUDIO, BLOCK, CHANNELS, CLUSTER, CODEC, DEPTH, DURATION, EBML, ENTRY, FRAME, GROUP, NUMBER, RATE, SEGMENT, SIMPLE, TIME, TRACKS, element, media_column, media_digests, mux, packet_table, parse, size_field, uint
from textmill.llm.warc import read_archives, record, train_dictionary, write_archives


def test_media_round_trip(odd_docs, odd_texts, no_docs):
    got = media_digests(media_column(odd_docs)).collect()
    want = {}
    for _, t in odd_texts:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw))
        media = mux(payload)
        want[hashlib.sha256(payload).hexdigest()] = (len(raw), len(payload), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
    assert len(got) == len(odd_texts)
    assert all(want[r.payload_sha256][1:] == (r.payload_bytes, r.tail_crc32, r.media_bytes, r.media_sha256) for r in got)
    assert media_digests(media_column(no_docs)).count() == 0
    packets = packet_table(media_column(odd_docs)).filter("doc_id = 7").orderBy("timestamp_ns").collect()
    assert all(p.size == FRAME and p.codec == "A_PCM/INT/LIT" for p in packets)
    assert [p.timestamp_ns for p in packets[:9]] == [72_000_000 * i for i in range(9)]
    assert any(p.cued for p in packets)


@pytest.mark.parametrize("kind", [1, 3])
def test_laces_of_other_kinds(kind):
    r = random.Random(kind)
    frames = [bytes(r.randrange(256) for _ in range(n)) for n in (300, 20, 700, 5)]
    sizes = [len(f) for f in frames]
    if kind == 1:
        head = b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    else:
        head = size_field(sizes[0], 2)
        for a, b in zip(sizes, sizes[1:-1]):
            head += size_field(b - a + (1 << 13) - 1, 2)
    block = b"\x81\x00\x05" + bytes([0x80 | kind << 1, len(frames) - 1]) + head + b"".join(frames)
    unknown = CLUSTER.to_bytes(4, "big") + b"\x01\xff\xff\xff\xff\xff\xff\xff" + uint(TIME, 7) + element(SIMPLE, block) + element(GROUP, element(BLOCK, block))
    data = element(EBML, b"") + element(SEGMENT, unknown)
    m = parse(data)
    assert [data[o : o + n] for _, _, o, n, _ in m.packets] == frames * 2
    assert m.packets[0][1] == 12_000_000 and m.clusters == 1
    with pytest.raises(ValueError):
        parse(data[:-3])


@pytest.mark.parametrize("entry, step", [
    (element(DURATION, (20_000_000).to_bytes(4, "big")), [20_000_000] * 4),
    (element(AUDIO, element(RATE, struct.pack(">f", 48000)) + uint(CHANNELS, 2) + uint(DEPTH, 16)), [100 * 1_000_000_000 // 192_000] * 4),
    (b"", [0] * 4),
])
def test_laced_frames_of_foreign_tracks(entry, step):
    tracks = element(TRACKS, element(ENTRY, uint(NUMBER, 3) + element(CODEC, b"A_PCM/INT/LIT") + entry))
    block = b"\x83\x00\x05" + bytes([0x84, 3]) + b"abcd" * 100
    m = parse(element(EBML, b"") + element(SEGMENT, tracks + element(CLUSTER, uint(TIME, 7) + element(SIMPLE, block))))
    assert [t for _, t, *_ in m.packets] == [12_000_000 + sum(step[:i]) for i in range(4)]
    assert [n for _, _, _, n, _ in m.packets] == [100] * 4


def test_damaged_media_raise_value_errors():
    data = mux(b"x" * FRAME * 300)
    assert len(parse(data).packets) == 300 and len(parse(data).cues) == 2
    r = random.Random(4)
    for _ in range(300):
        bad = bytearray(data[: r.randrange(1, len(data))] if r.random() < 0.5 else data)
        for _ in range(3):
            bad[r.randrange(min(len(bad), 400))] ^= 1 << r.randrange(8)
        try:
            parse(bytes(bad))
        except ValueError:
            pass


def test_dictionary_is_trained_on_whole_records():
    records = [record(i, f"http://x/{i}", b"<p>" + b"abc " * (i % 7) * 30, "D", None, False) for i in range(200)]
    d = train_dictionary(records)
    assert b"WARC-Type: response" in d or b"WARC/1.1" in d
    assert train_dictionary(records) == d and train_dictionary(records[:2]) == b""


def test_archives_round_trip(spark):
    r = random.Random(1)
    pages = [(i, f"http://x/{i}", "<p>" + "".join(r.choice("abc é") for _ in range(300)) + "</p>") for i in range(40)]
    pages += [(50, None, pages[3][2]), (2, "http://x/again", pages[3][2]), (51, "u", None), (52, "u\r\nv w", ""), (52, "u", ""), (60, "u", "x" * 2_000_000), (None, "u", pages[3][2])]
    df = spark.createDataFrame([(*p, "k", 1) for p in pages], "page_id long, url string, html string, digest string, first long")
    got = read_archives(write_archives(df)).collect()
    least: dict[str, int] = {}
    for i, _, h in pages:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    want = sorted((str(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if i == least[h or ""] else "revisit", None if i == least[h or ""] else least[h or ""]) for i, _, h in pages)
    assert sorted((str(x.page_id), x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got) == want
    assert all((x.payload is None) == (x.record_type == "revisit") for x in got)
    assert read_archives(write_archives(df.limit(0))).count() == 0


def test_media_without_packets_and_null_media(spark):
    from textmill.llm.matroska import element, media_digests, packet_table, parse

    head, empty = element(0x1A45DFA3, b""), element(0x1A45DFA3, b"") + element(0x18538067, b"")
    for data in (b"", head, b"no file at all"):
        with pytest.raises(ValueError):
            parse(data)
    df = spark.createDataFrame([(1, 0, bytearray(empty)), (2, 5, None)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media_digests(df).collect()}
    assert got[1].payload_bytes == 0 and "last_ns=-1" in got[1].feature and got[2].feature is None and got[2].n_bytes == 5
    assert packet_table(df).count() == 0
