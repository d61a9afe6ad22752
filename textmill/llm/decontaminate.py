"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short, documents long, so symmetric MinHash would miss them.
Items are partitioned by the size of their shingle sets, a class for each power
of two. An item's signature is its least hashes, as many as the largest set of
its class needs: of n shingles, floor((1 - containment) * n) + 1, so that a
document that contains enough of the item has one of them for certain. A
document's shingle hashes are looked up class by class; what they hit is
verified by the exact containment of shingles.

Items are taken in blocks of at most ``BLOCK`` items, each a file in the shared
folder and one pass over the documents, so what driver and executors hold is
bounded.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.shared import by_arrow, fresh_dir, rows_out, store
from textmill.llm.word_table import Hasher, batches_of

SHINGLE = 5
CONTAINMENT = 0.8
BLOCK = 20_000
STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of words in what ``cleaned`` returns: letters and digits, and everything beyond ASCII.
WORD = np.array([b > 127 or chr(b).isalnum() for b in range(256)])


#: Beyond ASCII, what shows nothing goes, and what is no letter, mark or number parts words.
HIDDEN, BORDER = regex.compile(r"\p{Cf}"), regex.compile(r"[^\x00-\x7f\p{L}\p{M}\p{N}]")


def cleaned(text: str) -> bytes:
    """Lower-cased UTF-8 in which only word characters are beyond ASCII."""
    text = text.lower()
    return (text if text.isascii() else BORDER.sub(" ", HIDDEN.sub("", text))).encode("utf-8", "surrogatepass")


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased UTF-8."""
    w = np.concatenate(([False], WORD[np.frombuffer(data, np.uint8)], [False]))
    return np.flatnonzero(w[1:] & ~w[:-1]), np.flatnonzero(~w[1:] & w[:-1])


def shingle_set(data: bytes, k: int) -> set[bytes]:
    """Distinct k-word shingles of lower-cased UTF-8; none for fewer words."""
    starts, ends = word_spans(data)
    words = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of runs of k words from the words' hashes."""
    out = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for i in range(k if len(out) else 0):
        out = (out * STEP + words[i : len(words) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class ItemTable:
    """The items of one block: per shingle length and size class the sorted signature hashes and whose they are."""

    def __init__(self, items: list[tuple[int, str]], k: int, containment: float) -> None:
        self.hasher, self.share = Hasher(), containment
        self.shingles: dict[int, tuple[int, set[bytes]]] = {}
        rows: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for n, (_, text) in enumerate(items):
            data = cleaned(text)
            length = min(k, len(word_spans(data)[0]))
            if not length:
                continue
            own = shingle_set(data, length)
            self.shingles[n] = (length, own)
            starts, ends = word_spans(data)
            h = np.unique(shingle_hashes(self.hasher(np.frombuffer(data, np.uint8), starts, ends), length))
            size = len(own).bit_length()
            rows[length, size] += [(int(x), n) for x in h[: int((1 - containment) * ((1 << size) - 1) + 1e-9) + 1]]
        self.sketch: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        for (length, _), pairs in sorted(rows.items()):
            pairs.sort()
            keys = np.array([x for x, _ in pairs], np.uint64)
            seen = np.zeros(1 << 16, bool)
            seen[(keys >> np.uint64(48)).astype(np.int64)] = True
            self.sketch[length].append((keys, np.array([n for _, n in pairs]), seen))

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, shingles of the item in the text, shingles of the item) of every contained item."""
        place = 0
        for part in batches_of([cleaned(t) for t in texts]):
            data = b"\n".join(part) + b"\n"
            starts, ends = word_spans(data)
            first = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(t) + 1 for t in part]))))
            words = self.hasher(np.frombuffer(data, np.uint8), starts, ends)
            found = set()
            for length, classes in self.sketch.items():
                h = shingle_hashes(words, length)
                top = (h >> np.uint64(48)).astype(np.int64)
                for keys, of, seen in classes:
                    at = np.flatnonzero(seen[top])
                    lo, hi = np.searchsorted(keys, h[at]), np.searchsorted(keys, h[at], "right")
                    for i in np.flatnonzero(hi > lo):
                        doc = int(np.searchsorted(first, at[i], "right")) - 1
                        found.update((doc, int(n)) for n in of[lo[i] : hi[i]])
            sets: dict[tuple[int, int], set[bytes]] = {}
            for doc, n in sorted(found):
                length, own = self.shingles[n]
                if (doc, length) not in sets:
                    sets[doc, length] = shingle_set(part[doc], length)
                common = len(own & sets[doc, length])
                if common >= self.share * len(own) - 1e-9:
                    yield place + doc, n, common, len(own)
            place += len(part)


def _blocks(items: DataFrame, id_col: str, text_col: str) -> list[str]:
    """Files of the items by ascending id, a block each; the driver holds one block at a time."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).orderBy("id", "t")
    folder, paths, local = fresh_dir(items.sparkSession, "items"), [], rows.toLocalIterator()
    while block := list(islice(local, BLOCK)):
        paths.append(f"{folder}/{len(paths):06d}.arrow")
        fs, at = store(paths[-1])
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        batch = rows_out({"id": (pa.int64(), [r[0] for r in block]), "t": (pa.string(), [r[1] for r in block])})
        with fs.open_output_stream(at, compression=None) as out, pa.ipc.new_stream(out, batch.schema) as stream:
            stream.write_batch(batch)
    return paths


_table: dict[tuple[str, int, float], tuple[ItemTable, list[int]]] = {}


def _loaded(path: str, k: int, containment: float) -> tuple[ItemTable, list[int]]:
    """Table and ids of a block; a worker keeps the last one."""
    key = (path, k, containment)
    if key not in _table:
        fs, at = store(path)
        with fs.open_input_stream(at, compression=None) as file:
            items = pa.ipc.open_stream(file).read_all().to_pydict()
        _table.clear()
        _table[key] = ItemTable(list(zip(items["id"], items["t"])), k, containment), items["id"]
    return _table[key]


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_common, n_shingles) of every document and item it contains.

    Words are runs of letters, combining marks and numbers of the lower-cased text
    without characters that show nothing, so dashes, quotes and blanks of any kind
    part them. An item is contained if the document has at least that share of its
    distinct k-word shingles; items of fewer words are one shingle of all their
    words; items without words are never contained. Null and empty texts contain
    nothing. Repeated rows repeat their matches. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    schema = "doc_id long, item_id long, n_common long, n_shingles long"

    def one(path: str) -> DataFrame:
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                table, ids = _loaded(path, k, containment)
                doc = b.column(0).to_pylist()
                got = [(doc[t], ids[n], c, s) for t, n, c, s in table.search([t or "" for t in b.column(1).to_pylist()])]
                yield rows_out({x: (pa.int64(), [g[i] for g in got]) for i, x in enumerate(("doc_id", "item_id", "n_common", "n_shingles"))})

        return by_arrow(rows, f, schema)

    parts = [one(b) for b in _blocks(items, item_col, item_text)]
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """The documents that contain no item, all columns as they are; rules as for ``contained_items``: null and empty texts stay, repeated rows and rows of one id are decided by their texts. No shuffle."""
    for path in _blocks(items, item_col, item_text):
        at = docs.columns.index(text_col)

        def f(batches: Iterator[pa.RecordBatch], path: str = path, at: int = at) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[t for t, *_ in _loaded(path, k, containment)[0].search([t or "" for t in b.column(at).to_pylist()])]] = False
                yield b.filter(pa.array(keep))

        docs = by_arrow(docs, f, docs.schema)
    return docs
