"""Word shingles and 64-bit SimHash fingerprints of byte strings.

Words are the maximal runs of bytes outside ``\\x20\\x09-\\x0D`` after A-Z have
been lower-cased, which is exactly what ``bytes.lower().split()`` yields.
"""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42
CHUNK = 1 << 16


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text; none for null and blank texts."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(ws: list[bytes], k: int) -> list[bytes]:
    """Space-joined runs of ``k`` words, repeats kept; fewer words: the whole sequence."""
    if not ws:
        return []
    if len(ws) <= k:
        return [b" ".join(ws)]
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [joined[a:b] for a, b in zip(starts[: len(ws) - k + 1].tolist(), ends[k - 1 :].tolist())]


def hashes(parts: list[bytes]) -> np.ndarray:
    """XXH64 of each part under the fixed seed."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, SEED) for p in parts), np.uint64, len(parts))


def simhash(h: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; 0 for none."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        rows = h[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(h)).tobytes(), "big")


def fingerprint(text: str | None, k: int) -> int:
    """SimHash of the text's k-word shingles."""
    return simhash(hashes(shingles(words(text), k)))


class WordSignatures:
    """256-bit SimHash over the set of a text's words, for near copies with scattered edits.

    One edited word changes one feature here but five of the 5-word shingles,
    so copies differ in fewer bits. Rows of +1/-1 per word are kept in a
    matrix of bounded size.
    """

    WORDS = 4
    CAP = 150_000

    def __init__(self) -> None:
        self.at: dict[bytes, int] = {}
        self.rows = np.empty((self.CAP, 64 * self.WORDS), np.int8)

    def __call__(self, ws: list[bytes]) -> np.ndarray:
        """Four unsigned 64-bit words, lowest bits last; zeros for no words."""
        votes, distinct = np.zeros(64 * self.WORDS, np.int32), list(set(ws))
        for i in range(0, len(distinct), 20_000):
            part = distinct[i : i + 20_000]
            if len(self.at) + len(part) > self.CAP:
                self.at.clear()
            new = [w for w in part if w not in self.at]
            if new:
                h = np.array([[xxhash.xxh64_intdigest(w, SEED + s) for s in range(self.WORDS)] for w in new], np.uint64)
                first = len(self.at)
                self.rows[first : first + len(new)] = np.unpackbits(h.astype(">u8").view(np.uint8), axis=1).astype(np.int8) * 2 - 1
                self.at.update(zip(new, range(first, first + len(new))))
            votes += self.rows[[self.at[w] for w in part]].sum(axis=0, dtype=np.int32)
        return np.packbits(votes > 0).view(">u8").astype(np.uint64)
