r"""Words of many texts as numbers, without a Python object a word.

A word is [^\x20\x09-\x0D]+. Its number is a polynomial of random values of its bytes, modulo
2^64, then mixed with its length: two given words collide with a probability of about 2^-60,
so among 10^9 distinct words some two do with one of about 1 in 2.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import offsets

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACES = [9, 10, 11, 12, 13, 32]
#: The factor from one byte to the next, 5 modulo 8, so that its powers repeat as late as any's.
_BASE = 0xD1342543DE82EF95
#: Bytes that are looked at together, but for longer words.
WINDOW = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_INSIDE = np.ones(256, bool)
_INSIDE[_SPACES] = False
_BYTE = mix(np.arange(1, 257, dtype="u8") * _ODD)
_BYTE[_SPACES] = 0
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = np.ones(1, "u8"), np.ones(1, "u8")


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    global _UP, _DOWN
    if len(_UP) < n:
        n = max(n, WINDOW)
        _UP, _DOWN = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
    return _UP, _DOWN


def _window(data: np.ndarray, cuts: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers and starts of the words in data; cuts: where texts start, a word's end too."""
    inside = _INSIDE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _factors(len(data))
    sums = value[data]
    sums *= up[: len(data)]
    total = np.cumsum(sums)
    own = (total[ends] - total[starts] + sums[starts]) * down[starts]
    return mix(own + (ends - starts).astype("u8") * _ODD), starts


def hashes(texts: pa.Array, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all words (u8) in a row, and how many each text has; null: none.
    fold: A-Z count as a-z."""
    if texts.null_count:
        texts = texts.fill_null("")
    cuts = offsets(texts).astype("i8")
    data = np.frombuffer(texts.buffers()[2] or b"", "u1")[cuts[0] : cuts[-1]]
    cuts = cuts - cuts[0]
    value, found, starts, at = _FOLDED if fold else _BYTE, [np.zeros(0, "u8")], [np.zeros(0, "i8")], 0
    while at < len(data):
        stop, size = len(data), WINDOW
        while at + size < len(data):  # cut behind the last blank, or at the last text's start, that the window holds
            blanks = np.flatnonzero(~_INSIDE[data[at : at + size]])
            inner = cuts[np.searchsorted(cuts, at + size, "right") - 1]
            stop = max(at + int(blanks[-1]) + 1 if len(blanks) else at, int(inner))
            if stop > at:
                break
            stop, size = len(data), 2 * size
        a, b = np.searchsorted(cuts, [at, stop])
        own, where = _window(data[at:stop], cuts[a:b] - at, value)
        found.append(own)
        starts.append(where + at)
        at = stop
    return np.concatenate(found), np.diff(np.searchsorted(np.concatenate(starts), cuts))
