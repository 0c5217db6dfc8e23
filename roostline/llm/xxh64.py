"""XXH64 of many spans of one byte array at once."""

from __future__ import annotations

import numpy as np

# The five primes of the XXH64 specification.
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray | np.uint64, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def _long_part(words: np.ndarray, starts: np.ndarray, stripes: np.ndarray, seed: np.uint64) -> np.ndarray:
    """Accumulators over whole stripes of 32 bytes, merged; every span here has one at least."""
    n = len(starts)
    v = [np.full(n, s, np.uint64) for s in (seed + P1 + P2, seed + P2, seed, seed - P1)]
    live = np.arange(n)
    k = 0
    while len(live):
        at = starts[live] + 32 * k
        for i in range(4):
            v[i][live] = _round(v[i][live], words[at + 8 * i])
        k += 1
        live = live[stripes[live] > k]
    h = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
    for x in v:
        h = (h ^ _round(np.uint64(0), x)) * P1 + P4
    return h


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """The hashes (uint64) of ``data[s:e]`` for each start and end; ``data`` is uint8."""
    with np.errstate(over="ignore"):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
        halves = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))
        s = np.uint64(seed)
        length = ends - starts
        h = np.full(len(starts), s + P5, np.uint64)
        long = np.flatnonzero(length >= 32)
        if len(long):
            h[long] = _long_part(words, starts[long], length[long] >> 5, s)
        h += length.astype(np.uint64)
        at, rest = starts + (length & ~31), length & 31
        for k in range(3):
            i = np.flatnonzero(rest >= 8 * k + 8)
            h[i] = _turn(h[i] ^ _round(np.uint64(0), words[at[i] + 8 * k]), 27) * P1 + P4
        at, rest = at + (rest & ~7), rest & 7
        i = np.flatnonzero(rest >= 4)
        h[i] = _turn(h[i] ^ (halves[at[i]].astype(np.uint64) * P1), 23) * P2 + P3
        at, rest = at + (rest & ~3), rest & 3
        for k in range(3):
            i = np.flatnonzero(rest > k)
            h[i] = _turn(h[i] ^ (padded[at[i] + k].astype(np.uint64) * P5), 11) * P1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        return h ^ (h >> np.uint64(32))
