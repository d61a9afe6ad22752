"""CRC-32C of many byte strings at once.

The checksum is linear, so the remainder of a message is the exclusive or of
those of its parts, each moved by the zero bytes behind it. Messages are padded
in front, where zeros change nothing, to whole blocks; pairs of neighbours are
joined level by level for all messages together, and the blocks of a message
are then moved by their distance from its end.
"""

from __future__ import annotations

import numpy as np

# Fixed value: the reflected polynomial of CRC-32C.
POLYNOMIAL = 0x82F63B78
BLOCK = 64
Matrix = list[int]


def _times(m: Matrix, v: int) -> int:
    """The matrix, given as images of the bits, applied to a vector of bits."""
    out = 0
    for bit in range(32):
        if v >> bit & 1:
            out ^= m[bit]
    return out


def _squared(m: Matrix) -> Matrix:
    return [_times(m, x) for x in m]


def _tables(m: Matrix) -> np.ndarray:
    """The matrix as two tables of 65 536 entries, for the lower and the upper half of a vector."""
    out = np.zeros((2, 1 << 16), np.uint32)
    for half in range(2):
        for bit in range(16):
            out[half, 1 << bit : 2 << bit] = out[half, : 1 << bit] ^ np.uint32(m[16 * half + bit])
    return out


def _one_bit() -> Matrix:
    """Moving a remainder by one zero bit."""
    return [POLYNOMIAL] + [1 << bit for bit in range(31)]


def _powers(n: int) -> list[Matrix]:
    """Moving by 1, 2, 4, ... zero bytes."""
    m = _one_bit()
    for _ in range(3):
        m = _squared(m)
    out = [m]
    while len(out) < n:
        out.append(_squared(out[-1]))
    return out


MOVES = _powers(34)
MOVE = [_tables(m) for m in MOVES]
#: Remainder of two bytes, read as a little-endian number: the number itself moved by two bytes.
PAIR = MOVE[1][0]


def _moved(v: np.ndarray, power: int) -> np.ndarray:
    low, high = MOVE[power]
    return low[v & np.uint32(0xFFFF)] ^ high[v >> np.uint32(16)]


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each part, as unsigned 32-bit integers."""
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    blocks = -(-n // BLOCK)
    pad = blocks * BLOCK - n
    zero = bytes(BLOCK)
    buf = np.frombuffer(b"".join([x for p, k in zip(parts, pad.tolist()) for x in (zero[:k], p)]), "<u2")
    v, width = PAIR[buf], 1
    while (2 << width) <= BLOCK:
        v = _moved(v[0::2], width) ^ v[1::2]
        width += 1
    last = np.cumsum(blocks)
    far = np.repeat(last, blocks) - 1 - np.arange(len(v))
    for bit in range(int(far.max()).bit_length() if len(far) else 0):
        at = np.flatnonzero(far >> bit & 1)
        v[at] = _moved(v[at], width + bit)
    out = np.zeros(len(parts), np.uint32)
    full = np.flatnonzero(blocks)
    if len(full):
        out[full] = np.bitwise_xor.reduceat(v, (last - blocks)[full])
    # the register starts with ones, which move by the whole length
    start = np.full(len(parts), 0xFFFFFFFF, np.uint32)
    for bit in range(int(n.max()).bit_length() if len(n) else 0):
        at = np.flatnonzero(n >> bit & 1)
        start[at] = _moved(start[at], bit)
    return out ^ start ^ np.uint32(0xFFFFFFFF)
