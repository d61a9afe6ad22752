"""SentencePiece encoding and decoding of merge-type vocabularies.

Symbols start as characters; the adjacent pair whose joined piece has the best
score is merged first, the leftmost of equals, until no pair is a piece. What is
left and isn't a piece falls back to byte pieces. The agenda of a long unit is a
heap of pairs by score and place over linked symbols. Short units share one
agenda: a matrix of pair scores with a row per unit, of which every step takes
the best pair of each row.

A text may be cut between two characters that are adjacent in no piece: before
a space mark, around a line feed, and before the stops of ``STOPS`` in
vocabularies that never join them to what precedes. The units between cuts are
merged alone and kept in a table that compares their bytes; every unit that
enters it is checked against the sentencepiece library. Where they differ the
library's ids count, the codec counts the unit in ``differing`` and warns: on
the texts and random strings of the tests that count is 0.
"""

from __future__ import annotations

import heapq
import re
import warnings
from collections.abc import Iterator

import numpy as np
import sentencepiece

from textmill.llm.word_table import WordTable, batches_of, pieces_of, ragged

SPACE = "▁"
STOPS = ",.;:!?"
#: Characters from which on a unit has an agenda of its own.
LONG = 128
#: Where very long texts may be cut: before a space that follows none, and before a line feed.
BORDER = re.compile(rb"(?<! ) |\n")


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str) -> None:
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): i for i in normal}
        self.score = {i: sp.get_score(i) for i in normal}
        joined = {x for p in self.pieces for x in zip(p, p[1:])}
        if any(b == SPACE != a or "\n" in (a, b) for a, b in joined):
            raise ValueError("the vocabulary has pieces across the borders of units")
        stops = [s for s in STOPS if not any(b == s and (a.isascii() and a.isalnum() or "\u00c0" <= a <= "\u00ff") for a, b in joined)]
        self.stop = np.isin(np.arange(256), [ord(s) for s in stops])
        self.open = np.array([b < 128 and chr(b).isalnum() for b in range(256)])  # bytes that a stop may be cut from
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # a symbol is a piece's id, or for other characters n plus the code point
        self.n = n
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int64)
        for p, i in self.pieces.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        part = lambda s: self.pieces.get(s, int(self.symbol[ord(s)]) if len(s) == 1 else -1)
        pairs = {(part(p[:at]), part(p[at:])): i for p, i in self.pieces.items() for at in range(1, len(p))}
        pairs = {(a << 21) | b: i for (a, b), i in pairs.items() if a >= 0 and b >= 0}
        self.key = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[k] for k in self.key.tolist()], np.int64)
        places = {score: r for r, score in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
        self.rank = np.array([places[sp.get_score(i)] for i in self.joined.tolist()], np.int32)
        self.agenda = dict(zip(self.key.tolist(), zip(self.rank.tolist(), self.joined.tolist())))
        self.none = np.int32(1 << 30)
        self.differing = 0
        self.table = WordTable(self._encode_units, [np.int32, np.uint8])

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joined piece of each pair of symbols; ``none`` where there is none or a symbol is missing (-1)."""
        k = (a << 21) | b
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        hit = (self.key[at] == k) & (a >= 0) & (b >= 0)
        return np.where(hit, self.rank[at], self.none), self.joined[at]

    def merge(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all units after all merges, one unit after another, and how many each has; units of similar length share a matrix."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(sizes, kind="stable")
        flat, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at, short = 0, int(np.count_nonzero(sizes < LONG))
        while at < short:
            top = max(int(sizes[order[at]]) * 5 // 4, 8)
            to = min(int(np.searchsorted(sizes[order], top, "right")), at + max(1, 60_000 // top), short)
            rows = order[at:to]
            codes = np.frombuffer("".join([units[i] for i in rows.tolist()]).encode("utf-32-le"), np.uint32)
            width = int(sizes[rows[-1]])
            m = np.full((len(rows), width + 1), -1, np.int64)
            m[np.arange(width + 1) < sizes[rows][:, None]] = self.symbol[codes]
            done = self._merge_rows(m)
            flat.append(done[done >= 0])
            counts.append((done >= 0).sum(axis=1))
            at = to
        for i in order[short:].tolist():
            done = self._merge_long(self.symbol[np.frombuffer(units[i].encode("utf-32-le"), np.uint32)].tolist())
            flat.append(np.array(done, np.int64))
            counts.append(np.array([len(done)]))
        of = np.empty(len(order), np.int64)
        of[order] = np.arange(len(order))
        counts = np.concatenate(counts)
        return ragged(np.concatenate(flat), np.concatenate(([0], np.cumsum(counts))), of)[0], counts[of]

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """Merges one unit by a heap of (rank, place of the left symbol, both symbols) over linked places; an entry whose symbols have changed is void."""
        n, known = len(symbols), self.agenda
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(hit[0], i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (hit := known.get(a << 21 | b))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = known[a << 21 | b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (hit := known.get(symbols[left] << 21 | symbols[right])):
                    heapq.heappush(heap, (hit[0], left, symbols[left], symbols[right]))
        return [x for x in symbols if x >= 0]

    def _merge_rows(self, m: np.ndarray) -> np.ndarray:
        """Merges the best pair of every row until none is left. A row's symbols stay packed to the left, -1 behind them."""
        final = m
        rank, piece = self._pair_rank(m[:, :-1], m[:, 1:])
        alive = np.arange(len(m))
        while len(alive):
            best = rank.argmin(axis=1)
            ok = rank[np.arange(len(m)), best] < self.none
            if not ok.all():
                final[alive[~ok], : m.shape[1]] = m[~ok]
                final[alive[~ok], m.shape[1] :] = -1
                m, rank, piece, best, alive = m[ok], rank[ok], piece[ok], best[ok], alive[ok]
                if not len(alive):
                    break
            r = np.arange(len(m))
            m[r, best] = piece[r, best]
            keep = np.ones(m.shape, bool)  # the right symbol of the pair goes, what follows moves up
            keep[r, best + 1] = False
            m = m[keep].reshape(len(m), -1)
            m = np.concatenate((m, np.full((len(m), 1), -1, np.int64)), axis=1)
            width = int((m >= 0).sum(axis=1).max())
            rank, piece = rank[keep[:, 1:]].reshape(len(m), -1), piece[keep[:, 1:]].reshape(len(m), -1)
            rank = np.concatenate((rank, np.full((len(m), 1), self.none, np.int32)), axis=1)
            piece = np.concatenate((piece, np.zeros((len(m), 1), np.int64)), axis=1)
            for side in (np.maximum(best - 1, 0), best):
                rank[r, side], piece[r, side] = self._pair_rank(m[r, side], m[r, side + 1])
            if width + 1 < m.shape[1]:
                m, rank, piece = m[:, : width + 1], rank[:, :width] if width else rank[:, :1], piece[:, :width] if width else piece[:, :1]
        return final

    def ids(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of merged symbols; symbols that are no pieces as byte pieces."""
        other = np.flatnonzero(symbols >= self.n)
        if not len(other):
            return symbols.astype(np.int32), counts
        sizes = np.ones(len(symbols), np.int64)
        spelt = [[self.bytes[b] for b in chr(s - self.n).encode("utf-8")] for s in symbols[other].tolist()]
        sizes[other] = [len(x) for x in spelt]
        out = np.repeat(symbols, sizes).astype(np.int32)
        out[np.repeat(symbols >= self.n, sizes)] = [i for x in spelt for i in x]
        ends = np.cumsum(counts)
        borders = np.concatenate(([0], np.cumsum(sizes)))
        return out, borders[ends] - borders[ends - counts]

    def _encode_units(self, raw: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        outs = []
        for at in range(0, len(raw), 8192):
            units = [u.decode("utf-8").replace(" ", SPACE) for u in raw[at : at + 8192]]
            ids, counts = self.ids(*self.merge(units))
            # the library puts a space mark first; a unit without one is checked behind a line feed, two ids in all
            want = self.library.encode([u[1:] if u[0] == SPACE else "\n" + u for u in units], num_threads=1)
            want = [[self.pieces[SPACE]] if u == SPACE else w if u[0] == SPACE else w[2:] for u, w in zip(units, want)]
            if [i for w in want for i in w] != ids.tolist() or [len(w) for w in want] != counts.tolist():
                own = np.split(ids, np.cumsum(counts)[:-1])
                other = [u for u, a, w in zip(units, own, want) if a.tolist() != w]
                self.differing += len(other)
                warnings.warn(f"{len(other)} units differ from the library's, the first is {other[0][:60]!r}", RuntimeWarning, stacklevel=2)
                ids, counts = np.array([i for w in want for i in w], np.int32), np.fromiter(map(len, want), np.int64, len(want))
            text = [f"{i}," for i in ids.tolist()]
            ends = np.cumsum(counts)
            borders = np.concatenate(([0], np.cumsum(np.fromiter(map(len, text), np.int64, len(text)))))
            outs.append((ids, counts, np.frombuffer("".join(text).encode(), np.uint8), borders[ends] - borders[ends - counts]))
        ids, counts, digits, widths = (np.concatenate(x) for x in zip(*outs))
        return [(ids, counts), (digits, widths)]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes]]:
        """Ids of each text, and their decimal text joined by commas."""
        raw = [(b" " + t.replace(SPACE, " ").encode("utf-8")) if t else b"" for t in texts]
        raw, of = pieces_of(raw, BORDER)
        got: list[list[tuple[np.ndarray, bytes]]] = [[] for _ in texts]
        for n, piece in zip(of, self._pieces(raw)):
            got[n].append(piece)
        for parts in got:
            yield parts[0] if len(parts) == 1 else (np.concatenate([ids for ids, _ in parts]), b",".join([digits for _, digits in parts]))

    def _pieces(self, raw: list[bytes]) -> Iterator[tuple[np.ndarray, bytes]]:
        for part in batches_of(raw):
            data = b"".join(part)
            buf = np.frombuffer(data, np.uint8)
            first = np.concatenate(([0], np.cumsum([len(t) for t in part])))
            starts = np.zeros(len(buf) + 1, bool)
            starts[first] = True
            space, line = buf == 32, buf == 10
            starts[1:-1] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1] | (self.stop[buf[1:]] & self.open[buf[:-1]])
            starts[2:-1] |= self.stop[buf[2:]] & (buf[:-2] == 0xC3)  # two bytes of a letter of Latin-1
            at = np.flatnonzero(starts)
            if len(buf):
                (ids, cuts), (digits, marks) = self.table.lookup(data, at[:-1], at[1:])
                digits = digits.tobytes()
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                if a == b:
                    yield np.zeros(0, np.int32), b""
                    continue
                i, j = np.searchsorted(at, (a, b))
                yield ids[cuts[i] : cuts[j]], digits[marks[i] : marks[j] - 1]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of the ids, by the library."""
        return self.library.decode(ids, num_threads=1)
