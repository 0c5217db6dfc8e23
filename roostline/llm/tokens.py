"""Words of a batch of texts as NumPy arrays: spans and 64-bit names, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Byte classes. White space: 0x20 and 0x09-0x0D. Punctuation: ASCII that is neither letter nor digit.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
IS_PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

PIECE = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * ODD)
OTHER_VALUES = mixed(np.arange(1001, 1257, dtype=np.uint64) * ODD)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, extended when a longer piece comes."""

    base = 0xD1342543DE82EF95
    inverse = pow(base, -1, 1 << 64)

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self.up, self.down


_powers_kept = _Powers()


def spans(data: np.ndarray, cuts: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``; no word crosses one of the offsets in ``cuts``."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separator[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[cuts] = True
    fresh[0] = fresh[-1] = True
    gap = ~inside
    first, last = inside.copy(), inside.copy()
    first[1:] &= gap[:-1] | fresh[1:-1]
    last[:-1] &= gap[1:] | fresh[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _VALUES) -> np.ndarray:
    """A 64-bit name for each word: a polynomial of its bytes, mixed. Works through pieces of 1 MB of text.

    With ``OTHER_VALUES`` it is a second name, independent of the first: words that share one do not share both.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, low + PIECE, "right")))
        piece = data[low : ends[upto - 1]]
        up, down = _powers_kept.upto(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(values[piece] * up[: len(piece)], out=sums[1:])
        s, e = starts[at:upto] - low, ends[at:upto] - low
        out[at:upto] = mixed((sums[e] - sums[s]) * down[s])
        at = upto
    return out


def groups(texts: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive texts of about ``most`` bytes: first, last + 1, their bytes, and offsets of each in them.

    Null texts are empty. A longer text is a group of its own.
    """
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, where, what = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
