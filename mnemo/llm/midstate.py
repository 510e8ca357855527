"""SHA-256 over whole arrays of messages, with states that can be kept and resumed.

A digest written as 64 hexadecimal characters fills exactly one block of SHA-256. So the state after
any number of such digests is eight words without a rest of unread bytes: 32 bytes that can be stored
in a table, copied, and resumed in another task. States and digests are arrays of shape (n, 8).
"""

from __future__ import annotations

import math

import numpy as np


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _cube_root(n: int) -> int:
    r = round(n ** (1 / 3))
    while r**3 > n:
        r -= 1
    while (r + 1) ** 3 <= n:
        r += 1
    return r


# By their definition: the first 32 bits of the fractions of square and cube roots of the first primes.
ROUNDS = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], dtype=np.uint32)
START = np.array([math.isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], dtype=np.uint32)
_HEX = np.frombuffer("".join(f"{b:02x}" for b in range(256)).encode(), dtype=np.uint16)


def start(n: int) -> np.ndarray:
    return np.repeat(START[None, :], n, axis=0)


def compress(states: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The states after one more block each: (n, 8) and (n, 16) big-endian words to (n, 8)."""
    w = [words[:, i].copy() for i in range(16)]
    a, b, c, d, e, f, g, h = (states[:, i].copy() for i in range(8))
    turn = lambda x, k: (x >> np.uint32(k)) | (x << np.uint32(32 - k))
    for t in range(64):
        if t >= 16:
            x, y = w[(t - 15) % 16], w[(t - 2) % 16]
            w[t % 16] = w[t % 16] + (turn(x, 7) ^ turn(x, 18) ^ (x >> np.uint32(3))) + w[(t - 7) % 16] + (turn(y, 17) ^ turn(y, 19) ^ (y >> np.uint32(10)))
        new = h + (turn(e, 6) ^ turn(e, 11) ^ turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUNDS[t] + w[t % 16]
        more = (turn(a, 2) ^ turn(a, 13) ^ turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = new + more, a, b, c, d + new, e, f, g
    return states + np.stack([a, b, c, d, e, f, g, h], axis=1)


def hex_block(digests: np.ndarray) -> np.ndarray:
    """Digests as blocks: the 16 words of their hexadecimal text."""
    raw = np.ascontiguousarray(digests.astype(">u4")).view(np.uint8).reshape(len(digests), 32)
    return np.ascontiguousarray(_HEX[raw]).view(">u4").reshape(len(digests), 16).astype(np.uint32)


def absorb(states: np.ndarray, digests: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
    """The states after one more digest each, or only ``where`` a mask is set."""
    if where is None or where.all():
        return compress(states, hex_block(digests))
    at = np.flatnonzero(where)
    if len(at):
        states = states.copy()
        states[at] = compress(states[at], hex_block(digests[at]))
    return states


def finish(states: np.ndarray, digests_read: np.ndarray) -> np.ndarray:
    """Final digests of states that have read so many digests each."""
    end = np.zeros((len(states), 16), dtype=np.uint32)
    end[:, 0] = 1 << 31
    bits = np.asarray(digests_read, dtype=np.uint64) * np.uint64(512)
    end[:, 14], end[:, 15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return compress(states, end)


def to_bytes(rows: np.ndarray) -> bytes:
    return rows.astype(">u4").tobytes()


def from_bytes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=">u4").astype(np.uint32).reshape(-1, 8)
