"""Fill-in-middle by a parallel automaton scan.

A text's units are lines. A deterministic automaton reads its bytes: it knows
whether a line is open and how much of a sentinel it has seen; a byte that
opens a line counts. A chunk of bytes doesn't know the state that it is entered
in, so it emits for every state the state that it ends in and the lines that
open in it. Such functions compose associatively (``then``): within a chunk by
a tree over its bytes, between chunks by a tree over blocks of chunks. That
resolves the entry state of every chunk and the lines before it; the chunks
that hold the two cuts select them from there, and everything else of the
document never has to be in one place.

Documents of at most ``CHUNK`` characters are one chunk and are done where they
are read. Longer ones are written as chunks, which are scanned, cut and put
into the order of the output as rows of their own; digests read them as sorted
streams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.llm.shared import by_arrow, rows_out, written

#: Characters of a chunk, and chunks of a block.
CHUNK, BLOCK = 32_768, 1024
#: Sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: States: a line is open (1) or not (0), plus 2 after "<", plus 4 after "<P", "<S" or "<M"; 8 and 9: a sentinel has occurred.
STATES, START, FOUND = 10, 0, 8
#: Classes of bytes: others, line feed, "<", the letters of the sentinels, ">".
OTHER, FEED, OPEN, NAME, CLOSE = range(5)
CLASS = np.zeros(256, np.uint8)
CLASS[[ord("\n"), ord("<"), ord("P"), ord("S"), ord("M"), ord(">")]] = FEED, OPEN, NAME, NAME, NAME, CLOSE


def _step(state: int, kind: int) -> int:
    seen, line = state & ~1, int(kind != FEED)
    if seen == FOUND or (seen == 4 and kind == CLOSE):
        return FOUND + line
    return line + (2 if kind == OPEN else 4 if seen == 2 and kind == NAME else 0)


#: For each class: the next state of every state, and whether a line opens.
NEXT = np.array([[_step(s, c) for s in range(STATES)] for c in range(5)], np.int8)
OPENS = np.array([[int(not s & 1) for s in range(STATES)] for _ in range(5)], np.int32)


def then(to: np.ndarray, opened: np.ndarray, to2: np.ndarray, opened2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The functions of rows of chunks followed by those of as many others."""
    return np.take_along_axis(to2, to.astype(np.intp), 1), opened + np.take_along_axis(opened2, to.astype(np.intp), 1)


def _telling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and classes of the bytes that can change the state: of a run of others or of names, the first two do."""
    kinds = CLASS[data]
    same = np.zeros(len(kinds), bool)
    same[2:] = (kinds[2:] == kinds[1:-1]) & (kinds[1:-1] == kinds[:-2]) & ((kinds[2:] == OTHER) | (kinds[2:] == NAME))
    at = np.flatnonzero(~same)
    return at, kinds[at]


def scan(data: np.ndarray) -> tuple[list[int], list[int]]:
    """For each state that the bytes are entered in: the state after them, and the lines that open in them."""
    kinds = _telling(data)[1]
    to, opened = NEXT[kinds], OPENS[kinds]
    if not len(to):
        return list(range(STATES)), [0] * STATES
    while len(to) > 1:
        even = len(to) & ~1
        a, b = then(to[:even:2], opened[:even:2], to[1:even:2], opened[1:even:2])
        to, opened = (np.concatenate((a, to[even:])), np.concatenate((b, opened[even:]))) if even < len(to) else (a, b)
    return to[0].tolist(), opened[0].tolist()


def line_starts(data: np.ndarray, entry: int) -> np.ndarray:
    """Places at which a line opens in bytes that are entered in that state."""
    after = np.flatnonzero(data == ord("\n")) + 1
    at = after[after < len(data)]
    return np.concatenate(([0], at)) if len(data) and not entry & 1 else at


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


@dataclass(frozen=True)
class Draws:
    """Which form a document takes and where it is cut, from the digest of its id: rates in percent, seed before the id."""

    rate: int = 100
    spm: int = 50
    seed: int = 7

    def of(self, doc_id: int | None) -> tuple[int, ...]:
        """Four numbers of 32 bits; a null id counts as no digits."""
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))

    def plan(self, doc_id: int | None, lines: int, found: bool) -> tuple[str, int, int]:
        """Form, and the lines before the end of prefix and middle."""
        a, b, c, d = self.of(doc_id)
        cuts = sorted((a % (lines + 1), b % (lines + 1)))
        return "plain" if found or not lines or c % 100 >= self.rate else "spm" if d % 100 < self.spm else "psm", cuts[0], cuts[1]


def arranged(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    """The output of a document in one of the forms."""
    if form == "plain":
        return prefix + middle + suffix
    p, s, m = PREFIX.encode() + prefix, SUFFIX.encode() + suffix, MIDDLE.encode() + middle
    return p + s + m if form == "psm" else s + p + m


def restored(form: str, output: bytes) -> bytes:
    """The text from its output."""
    if form == "plain":
        return output
    head, _, middle = output.partition(MIDDLE.encode())
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, two = head[len(first) :].partition(second.encode())
    return (one + middle + two) if form == "psm" else (two + middle + one)


SHORT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _short(rows: DataFrame, draws: Draws) -> DataFrame:
    """``SHORT`` for texts of one chunk."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for i, text in zip(ids, b.column(1).to_pylist()):
                raw = text.encode()
                data = np.frombuffer(raw, np.uint8)
                to, opened = scan(data)
                n = opened[START]
                form, first, second = draws.plan(i, n, to[START] >= FOUND)
                starts = np.append(line_starts(data, START), len(data))
                p, m = int(starts[first]), int(starts[second])
                plain = form == "plain"
                out.append((n, form, None if plain else _chars(data[:p]), None if plain else _chars(data[p:m]), arranged(form, raw[:p], raw[p:m], raw[m:]).decode()))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield rows_out({"doc_id": (pa.int64(), ids), **{c: (t, [x[j] for x in out]) for j, (c, t) in enumerate(zip(("n", "form", "prefix_chars", "middle_chars", "output"), kinds))}})

    return by_arrow(rows, f, SHORT)


def chunks_of(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """(key, doc_id, at, text): texts in chunks, in a table of the shared folder. ``rows`` has doc_id and text; key tells rows apart."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, doc, text in zip(*b.to_pydict().values()):
                for first in range(0, len(text), size * 64):  # a few MB a batch
                    part = [text[i : i + size] for i in range(first, min(len(text), first + size * 64), size)]
                    yield rows_out({"key": (pa.int64(), [key] * len(part)), "doc_id": (pa.int64(), [doc] * len(part)), "at": (pa.int64(), [first // size + i for i in range(len(part))]), "text": (pa.string(), part)})

    keyed = rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    return written(by_arrow(keyed, f, "key long, doc_id long, at long, text string", rows=8), "chunks")


def _scanned(chunks: DataFrame) -> DataFrame:
    """(key, doc_id, at, to, opened): the function of every chunk."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scan(np.frombuffer(t.encode(), np.uint8)) for t in b.column(3).to_pylist()]
            yield rows_out({"key": (pa.int64(), b.column(0).to_pylist()), "doc_id": (pa.int64(), b.column(1).to_pylist()), "at": (pa.int64(), b.column(2).to_pylist()), "to": (pa.list_(pa.int32()), [x for x, _ in got]), "opened": (pa.list_(pa.int64()), [x for _, x in got])})

    return by_arrow(chunks, f, "key long, doc_id long, at long, to array<int>, opened array<long>")


#: The function of a run of chunks: those of its members, one after the other.
COMPOSED = """aggregate(array_sort(collect_list(struct(at, to, opened))), named_struct('to', sequence(0, {last}), 'opened', array_repeat(0L, {states})),
(f, g) -> named_struct('to', transform(f.to, s -> g.to[s]), 'opened', transform(f.opened, (n, s) -> n + g.opened[f.to[s]])))"""
#: Entry state and lines before each member of a run that is entered in state ``s`` after ``n`` lines.
ENTRIES = """aggregate(members, named_struct('s', {s}, 'n', {n}, 'out', cast(array() as array<struct<at:bigint,entry:int,before:bigint,opened:bigint>>)),
(x, g) -> named_struct('s', g.to[x.s], 'n', x.n + g.opened[x.s], 'out', concat(x.out, array(named_struct('at', g.at, 'entry', x.s, 'before', x.n, 'opened', g.opened[x.s])))))"""


def entries(functions: DataFrame, draws: Draws) -> DataFrame:
    """(key, doc_id, at, entry, before, opened, n, form, first, second): per chunk its entry state, the lines before and in it, and the plan of its document."""
    composed = COMPOSED.format(last=STATES - 1, states=STATES)
    members = F.array_sort(F.collect_list(F.struct("at", "to", "opened"))).alias("members")
    blocks = functions.groupBy("key", "doc_id", F.expr(f"at div {BLOCK}").alias("block")).agg(F.expr(composed).alias("f"), members)
    of_blocks = blocks.select("key", "doc_id", F.col("block").alias("at"), "f.to", "f.opened").groupBy("key", "doc_id").agg(F.expr(composed).alias("whole"), members)
    resolved = of_blocks.withColumn("e", F.expr(ENTRIES.format(s=START, n="0L")))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pydict()
            got = [draws.plan(i, n, s >= FOUND) for i, n, s in zip(rows["doc_id"], rows["n"], rows["s"])]
            yield rows_out({"key": (pa.int64(), rows["key"]), "e": (b.column(3).type, b.column(3)), "n": (pa.int64(), rows["n"]), "form": (pa.string(), [x[0] for x in got]), "first": (pa.int64(), [x[1] for x in got]), "second": (pa.int64(), [x[2] for x in got])})

    planned = resolved.select("key", "doc_id", F.col("e.n").alias("n"), F.col("e.out").alias("e"), F.col("e.s").alias("s"))
    planned = by_arrow(planned, plan, "key long, e array<struct<at:bigint,entry:int,before:bigint,opened:bigint>>, n long, form string, first long, second long")
    entered = planned.select("key", "n", "form", "first", "second", F.inline("e")).select("key", F.col("at").alias("block"), "entry", "before", "n", "form", "first", "second")
    inner = blocks.select("key", "doc_id", "block", "members").join(entered, ["key", "block"])
    inner = inner.withColumn("e", F.expr(ENTRIES.format(s="entry", n="before") + ".out"))
    return inner.select("key", "doc_id", "n", "form", "first", "second", F.inline("e"))


#: Order of the parts of the output, sentinels before them; "plain" has text alone.
RANK = {"plain": (0, 0, 0), "psm": (1, 5, 3), "spm": (3, 5, 1)}
NAMES = (PREFIX, MIDDLE, SUFFIX)


def _cut(chunks: DataFrame, at_chunk: DataFrame) -> DataFrame:
    """(key, doc_id, n, form, part, rank, at, text): chunks cut into parts (0 prefix, 1 middle, 2 suffix; null for a sentinel), with the order of the output."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                raw = r["text"].encode()
                data = np.frombuffer(raw, np.uint8)
                starts, cuts = line_starts(data, r["entry"]), []
                for cut in (r["first"], r["second"]):
                    here = cut - r["before"]
                    cuts.append(0 if here < 0 else int(starts[here]) if here < len(starts) else len(raw))
                pieces = (raw[: cuts[0]], raw[cuts[0] : cuts[1]], raw[cuts[1] :])
                if r["form"] == "plain":
                    pieces = (raw, b"", b"")
                row = (r["key"], r["doc_id"], r["n"], r["form"])
                out += [(*row, k, RANK[r["form"]][k], r["at"], piece.decode()) for k, piece in enumerate(pieces) if piece]
                if not r["at"] and r["form"] != "plain":
                    out += [(*row, None, RANK[r["form"]][k] - 1, 0, NAMES[k]) for k in range(3)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string())
            yield rows_out({c: (t, [x[j] for x in out]) for j, (c, t) in enumerate(zip(("key", "doc_id", "n", "form", "part", "rank", "at", "text"), kinds))})

    rows = chunks.join(at_chunk.drop("doc_id"), ["key", "at"]).select("key", "doc_id", "n", "form", "first", "second", "entry", "before", "at", "text")
    return by_arrow(rows, f, "key long, doc_id long, n long, form string, part int, rank int, at long, text string", rows=64)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", draws: Draws = Draws()) -> tuple[DataFrame, DataFrame]:
    """Two tables: (doc_id, n, form, prefix_chars, middle_chars, output) of the documents of one chunk, and (key, doc_id, n, form, part, rank, at, text) of the longer ones.

    The second has the output of a document in pieces, ordered by rank and at; a
    sentinel is a piece of its own, key tells documents apart. Null texts count
    as empty and stay plain, as do those that hold a sentinel. Repeated rows
    come as often as they occur; equal ids draw alike, a null id draws as one
    without digits. Other columns are ignored.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    long = F.length("text") > CHUNK
    chunks = chunks_of(rows.filter(long))
    pieces = written(_cut(chunks, entries(_scanned(chunks), draws)), "fim")
    return _short(rows.filter(~long), draws), pieces


def streamed_digests(pieces: DataFrame, *order: str) -> DataFrame:
    """(key, sha256) of the texts of each key, one after the other in that order; a task holds one batch of them."""
    sent = pieces.select("key", *order, "text").repartition("key").sortWithinPartitions("key", *order).select("key", "text")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        out = lambda: rows_out({"key": (pa.int64(), [at]), "sha256": (pa.string(), [digest.hexdigest()])})
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key != at:
                    if digest:
                        yield out()
                    at, digest = key, hashlib.sha256()
                digest.update(text.encode())
        if digest:
            yield out()

    return by_arrow(sent, f, "key long, sha256 string", rows=64)


def _sections(pieces: DataFrame) -> DataFrame:
    """Pieces of the output without sentinels, with ``part`` as read from the last sentinel before them."""
    number = F.when(F.col("text") == PREFIX, 0).when(F.col("text") == MIDDLE, 1).when(F.col("text") == SUFFIX, 2)
    mark = F.when((F.col("form") != "plain") & F.col("text").isin(*NAMES), number)
    # the texts stay out of the window: it gets a row of numbers for each piece
    seen = pieces.select("key", "rank", "at", "form", mark.alias("mark"))
    ordered = Window.partitionBy("key").orderBy("rank", "at")
    section = seen.withColumn("part", F.coalesce(F.last("mark", True).over(ordered), F.lit(0))).filter("mark is null").select("key", "rank", "at", "part")
    return pieces.drop("part").join(section, ["key", "rank", "at"])


DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def fim_digests(short: DataFrame, pieces: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) per document, the texts being rebuilt from the outputs alone."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            outputs = [x.encode() for x in b.column(5).to_pylist()]
            back = [restored(form, x) for form, x in zip(b.column(2).to_pylist(), outputs)]
            sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], sha(outputs), sha(back)], names=[x.split()[0] for x in DIGESTS.split(", ")])

    own = _sections(pieces)
    length = lambda k: F.sum(F.when(F.col("part") == k, F.length("text")).otherwise(0))
    unless: Column = F.col("form") != "plain"
    facts = own.groupBy("key", "doc_id", "n", "form").agg(F.when(unless, length(0)).alias("prefix_chars"), F.when(unless, length(1)).alias("middle_chars"))
    output = streamed_digests(pieces, "rank", "at").withColumnRenamed("sha256", "output_sha256")
    text = streamed_digests(own, "part", "rank", "at").withColumnRenamed("sha256", "restored_sha256")
    return by_arrow(short, f, DIGESTS).unionByName(facts.join(output, "key").join(text, "key").drop("key"))
