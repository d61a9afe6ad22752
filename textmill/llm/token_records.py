"""Token-ID output as length-delimited binary records with a separate offset index.

Record: 8-byte little-endian length, 4-byte masked CRC of those 8 bytes, the
payload, 4-byte masked CRC of the payload. Payload: token ids as LEB128
varints. The checksums are CRC-32C, masked by the usual rule for framed records
(rotate right by 15, add 0xa282ead8), so common readers take the files. Index:
one entry of ``ENTRY`` per record, in the order of the records.

Documents are dealt by ranges of doc_id, so shard n holds smaller ids than
shard n+1, and each shard is written by one task under a name of its own per
attempt; a manifest table names the attempt that counts.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.llm.checksums import crc32c
from textmill.llm.shared import by_arrow, fresh_dir, rows_out, store, written
from textmill.llm.word_table import WordTable, batches_of, pieces_of, ragged

MASK_DELTA = 0xA282EAD8
#: Bytes of text in a shard, about, where the session's shuffle partitions would make larger ones.
SHARD_BYTES = 256 << 20
#: Words that a worker keeps at most.
WORDS = 900_000
HEAD = struct.Struct("<QI")
ENTRY = struct.Struct("<?qQQQ")  # id is present, id, offset, bytes of the record, tokens


def masked_crcs(parts: list[bytes]) -> list[int]:
    """Masked CRC-32C of each part."""
    crc = crc32c(parts).astype(np.uint64)
    return ((((crc >> np.uint64(15)) | (crc << np.uint64(17))) + np.uint64(MASK_DELTA)) & np.uint64(0xFFFFFFFF)).tolist()


def varints(ids: np.ndarray) -> bytes:
    """LEB128 of ids below 2**35."""
    v = ids.astype(np.uint64)[:, None] >> np.arange(0, 35, 7, dtype=np.uint64)
    more = v[:, 1:] > 0
    out = (v & np.uint64(0x7F)).astype(np.uint8)
    out[:, :-1] |= more.astype(np.uint8) << 7
    return out[np.concatenate((np.ones((len(ids), 1), bool), more), axis=1)].tobytes()


def from_varints(data: bytes) -> np.ndarray:
    """The ids back."""
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    if not len(last):
        return np.zeros(0, np.uint64)
    first = np.concatenate(([0], last[:-1] + 1))
    out = (raw[first] & 0x7F).astype(np.uint64)
    for place in range(1, int((last - first).max()) + 1):
        longer = last - first >= place
        out[longer] |= (raw[first[longer] + place] & np.uint64(0x7F)).astype(np.uint64) << np.uint64(7 * place)
    return out


def frames(payloads: list[bytes]) -> list[bytes]:
    """Records of the payloads."""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    crcs = masked_crcs(lengths + payloads)
    return [n + struct.pack("<I", x) + p + struct.pack("<I", y) for n, p, x, y in zip(lengths, payloads, crcs, crcs[len(payloads) :])]


def unframed(records: list[bytes]) -> list[bytes]:
    """The payloads of records; ValueError if a length or checksum is wrong."""
    if any(len(r) < HEAD.size + 4 for r in records):
        raise ValueError("a record is cut off")
    payloads = [r[HEAD.size : -4] for r in records]
    crcs = masked_crcs([r[:8] for r in records] + payloads)
    for r, p, x, y in zip(records, payloads, crcs, crcs[len(payloads) :]):
        if HEAD.unpack_from(r) != (len(p), x) or struct.unpack_from("<I", r, len(r) - 4) != (y,):
            raise ValueError("damaged record")
    return payloads


def entry(doc: int | None, offset: int, size: int, tokens: int) -> bytes:
    """One entry of the index."""
    return ENTRY.pack(doc is not None, doc or 0, offset, size, tokens)


def entries_of(data: bytes) -> list[tuple[bool, int, int, int, int]]:
    """All entries of an index."""
    return list(ENTRY.iter_unpack(data))


class WordIds:
    """Varint payloads of texts: the library encodes each distinct chunk once.

    Chunks end at ASCII white space, over which the tokenizer's own rules never
    join, and before a comma or full stop between an ASCII letter and white
    space, where they always cut. A-Z are lower-cased first, as the tokenizer
    does, unless the text has combining marks, which it composes before that, or
    could hold a special token, which it looks for before that. Special tokens
    hold no white space, so each stands in one chunk.
    """

    BLANK = np.isin(np.arange(256), np.frombuffer(b"\t\n\x0b\x0c\r ", np.uint8))
    LETTER = np.isin(np.arange(256), np.frombuffer(bytes(range(97, 123)), np.uint8))
    STOP = np.isin(np.arange(256), np.frombuffer(b",.", np.uint8))
    MARK = re.compile("[\u0300-\u036f]")
    BORDER = re.compile(rb"[\t-\r ]")
    PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+").fullmatch

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(self.BORDER.search(t.encode("utf-8")) for t in special):
            raise ValueError("the vocabulary has special tokens over white space")
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)", re.IGNORECASE)
        self.table = WordTable(self._encode, [np.uint8, np.int64], WORDS)

    def _encode(self, chunks: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        words = [c.decode("utf-8") for c in chunks]
        plain = [i for i, w in enumerate(words) if self.PLAIN(w)]  # one piece each: many share one call
        flat, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            e = self.tokenizer.encode(" ".join([words[i] for i in some]), add_special_tokens=False)
            flat.append(np.array(e.ids, np.uint64))
            sizes.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)))
        taken = set(plain)
        rest = [i for i in range(len(words)) if i not in taken]
        for e in self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False):
            flat.append(np.array(e.ids, np.uint64))
            sizes.append(np.array([len(e.ids)], np.int64))
        # back into the order of the words
        place = np.empty(len(words), np.int64)
        place[np.array(plain + rest, np.int64)] = np.arange(len(words))
        counts = np.concatenate(sizes)
        flat = ragged(np.concatenate(flat), np.concatenate(([0], np.cumsum(counts))), place)[0]
        counts = counts[place]
        bounds = np.concatenate(([0], np.cumsum(1 + sum((flat >> np.uint64(7 * k) > 0).astype(np.int64) for k in range(1, 5)))))
        ends = np.cumsum(counts)
        return [(np.frombuffer(varints(flat), np.uint8), bounds[ends] - bounds[ends - counts]), (counts, np.ones(len(words), np.int64))]

    def __call__(self, texts: list[str]) -> Iterator[tuple[bytes, int]]:
        """Payload and number of ids of each text."""
        raw = [t.encode("utf-8") if self.MARK.search(t) or self.special.search(t) else t.encode("utf-8").lower() for t in texts]
        raw, of = pieces_of(raw, self.BORDER)
        got: list[tuple[list[bytes], int]] = [([], 0) for _ in texts]
        for n, (payload, count) in zip(of, self._pieces(raw)):
            got[n] = (got[n][0] + [payload], got[n][1] + count)
        for parts, count in got:
            yield b"".join(parts), count

    def _pieces(self, raw: list[bytes]) -> Iterator[tuple[bytes, int]]:
        for part in batches_of(raw):
            data = b"\n".join(part) + b"\n"
            buf = np.frombuffer(data, np.uint8)
            blank = self.BLANK[buf]
            start = ~blank
            start[1:] &= blank[:-1]
            start[1:-1] |= self.LETTER[buf[:-2]] & self.STOP[buf[1:-1]] & blank[2:]
            stop = np.zeros(len(buf) + 1, bool)
            stop[1:] |= ~blank
            stop[:-1] &= blank | start
            stop[-1] = not blank[-1]
            starts, ends = np.flatnonzero(start), np.flatnonzero(stop)
            (payload, cuts), (counts, _) = self.table.lookup(data, starts, ends)
            total = np.concatenate(([0], np.cumsum(counts)))
            payload = payload.tobytes()
            at = 0
            for t in part:
                end = at + len(t)
                i, j = np.searchsorted(starts, (at, end))
                yield payload[cuts[i] : cuts[j]], int(total[j] - total[i])
                at = end + 1


def write_token_records(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenises every whole text and writes the shards; returns the manifest: shard, path, index, records, tokens.

    Null and empty texts are records that hold the end id alone. Rows come in
    ascending id, null ids first, repeated ids by text. An empty table writes no
    shard. Texts of any length are one record.
    """
    folder, end = fresh_dir(docs.sparkSession, "token-records"), varints(np.array([end_id]))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, encode, at, n, tokens = f"{folder}/{task.partitionId():06d}-{uuid.uuid4().hex}", None, 0, 0, 0
        files = []
        for b in batches:
            if encode is None:
                encode = cached_encoder(tokenizer)
                for kind in ("rec", "idx"):
                    fs, path = store(f"{name}.{kind}")
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    files.append(fs.open_output_stream(path, compression=None))
            ids = b.column(0).to_pylist()
            got = list(encode([t or "" for t in b.column(1).to_pylist()]))
            for doc, record, (_, count) in zip(ids, frames([payload + end for payload, _ in got]), got):
                files[0].write(record)
                files[1].write(entry(doc, at, len(record), count + 1))
                at, n, tokens = at + len(record), n + 1, tokens + count + 1
        if files:
            for x in files:
                x.close()
            yield rows_out({"shard": (pa.int32(), [task.partitionId()]), "path": (pa.string(), [f"{name}.rec"]), "index": (pa.string(), [f"{name}.idx"]), "records": (pa.int64(), [n]), "tokens": (pa.int64(), [tokens])})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    return written(by_arrow(rows.repartitionByRange(shards, "id").sortWithinPartitions("id", "text"), f, "shard int, path string, index string, records long, tokens long"), "token-manifest")


_encoders: dict[str, WordIds] = {}


def cached_encoder(path: str) -> WordIds:
    """One encoder per worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def read_token_records(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read from the files through their index; checksums are verified."""
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.withColumn("before", before).select("path", "index", "before")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, index, start in zip(*(c.to_pylist() for c in b.columns)):
                fs, at = store(index)
                entries = entries_of(fs.open_input_stream(at, compression=None).read())
                fs, at = store(path)
                with fs.open_input_file(at) as file:
                    for i in range(0, len(entries), 256):
                        some = entries[i : i + 256]
                        first = some[0][2]
                        block = file.read_at(some[-1][2] + some[-1][3] - first, first)
                        got = from_varints(b"".join(unframed([block[x[2] - first : x[2] - first + x[3]] for x in some]))).astype("<u4").tobytes()
                        borders = np.concatenate(([0], np.cumsum([x[4] for x in some])))
                        if len(got) != 4 * borders[-1]:
                            raise ValueError("the index names another number of tokens")
                        crcs = [zlib.crc32(got[4 * a : 4 * b]) for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]
                        yield rows_out({"doc_id": (pa.int64(), [x[1] if x[0] else None for x in some]), "start": (pa.int64(), (start + borders[:-1]).tolist()), "n_tokens": (pa.int64(), [x[4] for x in some]), "ids_crc32": (pa.int64(), crcs)})
                        start += int(borders[-1])

    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return by_arrow(shards.repartition(parts), f, "doc_id long, start long, n_tokens long, ids_crc32 long")
