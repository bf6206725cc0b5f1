"""Which points a game ever held black and white stones on, as bits.

Two arrays of 64-bit words a game, two rows of a board (of up to 26 lines) to a word. A
stone that a query wants must have been set at some time, so a test of some words decides
most games without their moves, and before any event is unnested.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = 13
#: The arrays' names in the database.
COLUMNS = {"B": "black", "W": "white"}


def point_words(moves: Column, color: str) -> Column:
    """The words of all points where the moves set a stone of the colour."""
    own = F.filter(moves, lambda m: (m["color"] == color) & m["x"].isNotNull())
    bit = lambda m: F.call_function("shiftleft", F.lit(1).cast("long"), m["y"] % 2 * 32 + m["x"])
    word = lambda w: F.aggregate(F.filter(own, lambda m: F.floor(m["y"] / 2) == w), F.lit(0).cast("long"), lambda a, m: a.bitwiseOR(bit(m)))
    return F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), word)


def masks(points: Iterable[tuple[int, int]]) -> dict[int, int]:
    """Words that have bits of the points, each as a signed number."""
    out: dict[int, int] = {}
    for x, y in points:
        out[y // 2] = out.get(y // 2, 0) | 1 << (y % 2 * 32 + x)
    return {w: m - (1 << 64) if m >> 63 else m for w, m in sorted(out.items())}


def holds(words: Column, points: Iterable[tuple[int, int]]) -> Column:
    """Whether all the points are among them."""
    out = F.lit(True)
    for w, m in masks(points).items():
        mask = F.lit(m).cast("long")
        out = out & (F.coalesce(F.get(words, F.lit(w)), F.lit(0)).bitwiseAND(mask) == mask)
    return out


def may_match(black: Column, white: Column, rows: list[tuple[int, int, int, int, str]]) -> Column:
    """Whether some variant of a pattern (rows of pattern.variants) can occur: all its stones were once set."""
    by: dict[tuple[int, int], dict[str, list]] = {}
    for t, s, x, y, want in rows:
        by.setdefault((t, s), {"B": [], "W": [], "E": []})[want].append((x, y))
    out = F.lit(not by)
    for stones in by.values():
        out = out | (holds(black, stones["B"]) & holds(white, stones["W"]))
    return out
