"""Dictionary-compressed WARC archives.

A Zstandard dictionary is trained on records as they are archived, headers
included, of a bounded sample that stable keys choose. Each archive starts with a skippable frame (magic 0x184D2A5D) that holds it, and
each record is a frame of its own, so any record can be read from its byte
range and the dictionary. Records of equal payloads but the first are revisits
without a payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import warnings
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.shared import bounded_sample, by_arrow, fresh_dir, joined, rows_out, store, written

# Frame magic and profile name of the public formats.
DICT_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "2024-01-01T00:00:00Z"

#: Records that train the dictionary at most, bytes of them in all that do, and of the payload of one. Whole records are taken.
SAMPLE_RECORDS = 1000
SAMPLE_BYTES = 16 << 20
SAMPLE_PAYLOAD = 1 << 16
DICT_BYTES = 65_536
#: Groups of equal payloads that are broadcast at most (28 bytes each); beyond, only dense ones are.
BROADCAST_GROUPS = 50_000


def train_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from whole records up to ``SAMPLE_BYTES``; empty, as the format allows, where they are too few or too small for the trainer."""
    samples, full = [], 0
    for r in records:
        if full + len(r) <= SAMPLE_BYTES:
            samples.append(r)
            full += len(r)
    if len(samples) < 8 or full < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, full // 8), samples).as_bytes()
    except zstandard.ZstdError as e:
        warnings.warn(f"no dictionary: {e}", stacklevel=2)
        return b""


def record_id(page: int | None) -> str:
    """The same id for the same page in every run."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page/{page}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One WARC record."""
    clean = (url or "").replace("\r", "").replace("\n", "").replace(" ", "%20") or f"urn:page:{page}"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Target-URI: {clean}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page is None else page}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}", f"X-Refers-To-Page: {'' if first is None else first}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes an archive per partition; returns the manifest (path, offset, length) of its records.

    Null payloads are empty ones. Of equal payloads the record with the least
    page_id is the response, the others revisit it; rows that repeat that id and
    payload are responses too. A null id comes after all others.
    """
    spark = pages.sparkSession
    folder = fresh_dir(spark, "warc")
    payload = F.encode(F.coalesce(pages[html_col].cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(pages[id_col].cast("long").alias("page"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    digests = written(rows.select("page", "digest", F.octet_length("payload").alias("size")), "digests")
    groups = written(digests.groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "groups")
    # groups of many records are few and broadcast; payloads of the others are joined by a shuffle in which no digest is dense
    total = groups.agg(F.sum("n")).first()[0] or 0
    chosen = bounded_sample(digests.filter(F.col("size") <= SAMPLE_PAYLOAD), SAMPLE_RECORDS, "page", "digest").select("page", "digest").distinct()
    sample = rows.join(F.broadcast(chosen), ["page", "digest"], "left_semi").dropDuplicates(["page", "digest"])
    texts = sorted(record(r.page, r.url, bytes(r.payload), base64.b32encode(r.digest).decode(), None, False) for r in sample.collect())  # SAMPLE_RECORDS of SAMPLE_PAYLOAD bytes at most
    dictionary = train_dictionary(texts)
    small = groups.agg(F.count(F.lit(1))).first()[0] <= BROADCAST_GROUPS
    if small:
        rows = rows.join(F.broadcast(groups.drop("n")), "digest", "left")
    else:
        rows = joined(rows, groups, "digest", total).unionByName(rows.join(groups.select("digest"), "digest", "left_anti").withColumn("first", F.lit(None).cast("long")))
    rows = rows.select("page", "url", "payload", "digest", "first")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        out, at = None, 0
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for b in batches:
            if out is None:
                fs, where = store(path)
                fs.create_dir(where.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(where, compression=None)
                out.write(DICT_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary)
                at = 8 + len(dictionary)
            offsets, lengths = [], []
            for page, url, data, digest, first in zip(*(c.to_pylist() for c in b.columns)):
                revisit = first is not None and page != first
                frame = pack.compress(record(page, url, data, base64.b32encode(digest).decode(), first, revisit))
                out.write(frame)
                offsets.append(at)
                lengths.append(len(frame))
                at += len(frame)
            yield rows_out({"path": (pa.string(), [path] * len(offsets)), "offset": (pa.int64(), offsets), "length": (pa.int64(), lengths)})
        if out is not None:
            out.close()

    return written(by_arrow(rows, f, "path string, offset long, length long", rows=64), "warc-manifest")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record (the HTTP body)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, body = block.partition(b"\r\n\r\n")
    fields["http-length"] = next(x.split(b": ")[1].decode() for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
    return fields, body


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of every record, read from its byte range. Digests of responses are verified; a revisit's payload is null."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, unpack = None, None, None
        for b in batches:
            rows = []
            for where, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if where != path:
                    fs, at = store(where)
                    path, file = where, fs.open_input_file(at)
                    head = file.read_at(8, 0)
                    if int.from_bytes(head[:4], "little") != DICT_MAGIC:
                        raise ValueError("the archive has no dictionary frame")
                    dictionary = file.read_at(int.from_bytes(head[4:], "little"), 8)
                    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
                fields, body = parse_record(unpack.decompress(file.read_at(length, offset)))
                digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
                if not revisit and (digest != base64.b32encode(hashlib.sha1(body).digest()).decode() or len(body) != int(fields["http-length"])):
                    raise ValueError("a payload differs from its digest")
                number = lambda s: int(s) if s else None
                rows.append((number(fields["X-Page-ID"]), int(fields["http-length"]), digest, fields["WARC-Type"], number(fields.get("X-Refers-To-Page", "")), None if revisit else body))
            cols = list(zip(*rows)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield rows_out({c: (t, list(v)) for c, t, v in zip(("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"), types, cols)})

    return by_arrow(manifest.select("path", "offset", "length"), f, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
