"""A bounded table of encoded words, looked up for whole batches of text at once.

Words are byte ranges of a buffer. They get a 64-bit polynomial hash from prefix
sums (two numpy passes over the bytes), and an open-addressing table maps hashes
to rows of ragged output. A hash only proposes a row: the bytes of the row's
word are compared with the word's own, and words that share a hash with another
one get rows of their own. Only words not seen before reach the encoder.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

BASE = 0x9E3779B97F4A7C15
CAP = 400_000
ZEROS = [bytes(-n & 7) for n in range(8)]
#: Bits of the last eight bytes that belong to a word of so many bytes over a multiple of eight.
MASK = np.array([(1 << 64) - 1, *((1 << 8 * n) - 1 for n in range(1, 8))], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, b = 1, np.uint64(base)
    while done < n:
        m = min(done, n - done)
        with np.errstate(over="ignore"):
            out[done : done + m] = out[:m] * (out[done - 1] * b)
        done += m
    return out


class Hasher:
    """Hashes of byte ranges; equal ranges have equal hashes wherever they stand."""

    def __init__(self) -> None:
        self.byte = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(0, np.uint64)

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(buf)
        if len(self.up) < n:
            self.up, self.down = _powers(BASE, n + n // 2), _powers(pow(BASE, -1, 1 << 64), n + n // 2)
        h = np.zeros(n + 1, np.uint64)
        np.cumsum(self.byte[buf] * self.up[:n], out=h[1:])
        return ((h[ends] - h[starts]) * self.down[starts] ^ (ends - starts).astype(np.uint64)) | np.uint64(1)


class Grown:
    """An array that grows at its end; ``data`` has room behind the ``n`` values that count."""

    def __init__(self, kind: type, first: tuple = ()) -> None:
        self.data, self.n = np.array(first, kind), len(first)

    def put(self, values: np.ndarray) -> None:
        """Appends values; room grows by half, so each is copied a few times at most."""
        end = self.n + len(values)
        if end > len(self.data):
            grown = np.empty(max(end, len(self.data) * 3 // 2), self.data.dtype)
            grown[: self.n] = self.data[: self.n]
            self.data = grown
        self.data[self.n : end] = values
        self.n = end


class WordTable:
    """Rows of one or more ragged outputs per word. ``encode`` gets a list of words as bytes and returns, for each output, the values of all words one after another and each word's number of values."""

    def __init__(self, encode: Callable[[list[bytes]], list[tuple[np.ndarray, np.ndarray]]], kinds: list[type], cap: int | None = None) -> None:
        self.encode, self.kinds, self.hash, self.cap = encode, kinds, Hasher(), cap or CAP
        self.bits = (4 * self.cap).bit_length()  # at most a quarter to a half of the slots are taken
        self.clear()

    def clear(self) -> None:
        """Forgets all words."""
        self.key, self.row = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.n = 0
        # output 0 is the word itself in units of eight bytes, filled with zeros
        self.at = [Grown(np.int64, (0,)) for _ in range(len(self.kinds) + 1)]
        self.flat = [Grown(k) for k in (np.uint64, *self.kinds)]
        self.size = Grown(np.int64)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 if unknown."""
        out, slot, todo = np.full(len(h), -1, np.int32), self._slot(h), np.arange(len(h))
        while len(todo):
            k = self.key[slot]
            hit = k == h[todo]
            out[todo[hit]] = self.row[slot[hit]]
            on = ~hit & (k != 0)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _add(self, h: np.ndarray) -> None:
        """Keys of the next rows."""
        slot, rows = self._slot(h), np.arange(self.n, self.n + len(h), dtype=np.int32)
        while len(h):
            free = self.key[slot] == 0
            self.key[slot[free]] = h[free]
            mine = self.key[slot] == h
            self.row[slot[mine]] = rows[mine]
            h, rows, slot = h[~mine], rows[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)

    def _append(self, words: list[bytes]) -> None:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        lanes = np.frombuffer(b"".join([w + ZEROS[len(w) & 7] for w in words]), np.uint64)
        for i, (flat, n) in enumerate([(lanes, sizes + 7 >> 3), *self.encode(words)]):
            self.at[i].put(self.at[i].data[self.at[i].n - 1] + np.cumsum(n))
            self.flat[i].put(flat)
        self.size.put(sizes)
        self.n += len(words)

    def _differ(self, lanes: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Places of the words whose bytes aren't those of their rows; ``lanes`` has the eight bytes from each byte of the buffer on."""
        sizes = ends - starts
        wrong = self.size.data[rows] != sizes
        same = np.flatnonzero(~wrong & (sizes > 0))
        if len(same):
            n = sizes[same] + 7 >> 3
            borders = np.concatenate(([0], np.cumsum(n)[:-1]))
            step = np.arange(int(n.sum())) - np.repeat(borders, n)
            own = lanes[np.repeat(starts[same], n) + 8 * step]
            own[borders + n - 1] &= MASK[sizes[same] & 7]
            unlike = self.flat[0].data[np.repeat(self.at[0].data[rows[same]], n) + step] != own
            if unlike.any():
                wrong[same] = np.logical_or.reduceat(unlike, borders)
        return np.flatnonzero(wrong)

    def _rows(self, data: bytes, lanes: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Row of every word, in order; encodes the new ones. Rows hold until the next call."""
        out = self._find(h)
        new = np.flatnonzero(out < 0)
        if len(new):
            fresh, first = np.unique(h[new], return_index=True)
            if self.n + len(fresh) > self.cap:
                self.clear()
                fresh, first = np.unique(h, return_index=True)
                new = np.arange(len(h))
            where = new[first]
            words = [data[x:y] for x, y in zip(starts[where].tolist(), ends[where].tolist())]
            self._add(fresh)
            self._append(words)
            out[new] = self._find(h[new])
        other = self._differ(lanes, starts, ends, out)
        if len(other):
            # another word has the hash: these get rows without a key, found again only within this call
            words = [data[x:y] for x, y in zip(starts[other].tolist(), ends[other].tolist())]
            place = {w: self.n + i for i, w in enumerate(dict.fromkeys(words))}
            self._append(list(place))
            out[other] = [place[w] for w in words]
        return out

    def lookup(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each output its values of all words of the buffer, one after another, and the borders between words.

        Words are looked up in blocks that the table has room for, so a text may
        hold any number of different ones.
        """
        h = self.hash(np.frombuffer(data, np.uint8), starts, ends)
        lanes = np.ndarray((len(data),), "<u8", data + bytes(8), strides=(1,))
        parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in self.kinds]
        for at in range(0, len(h), self.cap):
            some = slice(at, at + self.cap)
            rows = self._rows(data, lanes, starts[some], ends[some], h[some])
            for i, part in enumerate(parts):
                part.append(ragged(self.flat[i + 1].data, self.at[i + 1].data, rows))
        out = []
        for part, kind in zip(parts, self.kinds):
            if len(part) == 1:
                out.append(part[0])
                continue
            sizes = np.concatenate([np.diff(b) for _, b in part] or [np.zeros(0, np.int64)])
            out.append((np.concatenate([v for v, _ in part] or [np.zeros(0, kind)]), np.concatenate(([0], np.cumsum(sizes)))))
        return out


def ragged(flat: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a ragged array, one after another, and the borders between them."""
    first = at[rows]
    sizes = at[rows + 1] - first
    borders = np.concatenate(([0], np.cumsum(sizes)))
    return flat[np.repeat(first - borders[:-1], sizes) + np.arange(borders[-1])], borders


def batches_of(texts: list[bytes], size: int = 1 << 20) -> list[list[bytes]]:
    """Consecutive groups of texts of about ``size`` bytes; a longer text stands alone."""
    out: list[list[bytes]] = []
    full = 0
    for t in texts:
        if not out or full + len(t) > size:
            out.append([])
            full = 0
        out[-1].append(t)
        full += len(t)
    return out


def pieces_of(texts: list[bytes], border: re.Pattern[bytes], size: int = 1 << 22) -> tuple[list[bytes], list[int]]:
    """Texts cut where ``border`` matches behind each ``size`` bytes, and whose piece each is: very long texts are encoded piece by piece."""
    out, of = [], []
    for n, t in enumerate(texts):
        at = 0
        while len(t) - at > size and (m := border.search(t, at + size)):
            out.append(t[at : m.start()])
            of.append(n)
            at = m.start()
        out.append(t[at:] if at else t)
        of.append(n)
    return out, of
