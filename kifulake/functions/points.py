"""Board points: letters, human names, and the eight symmetries, as Columns and in Python.

A move is a struct with color ('B', 'W', or 'E' for a cleared point), x and y from 0, and
mv, its two letters; a pass has mv 'tt' (or '' on boards over 19) and x = y = null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOVE = "struct<color:string,x:int,y:int,mv:string>"
#: Moves that no symmetry touches: passes and placeholders for moves that aren't there.
FIXED = ("tt", "??", "zz", "")


def mirrored(t: int, x, y, last):
    """(x, y) under symmetry t (0 to 7) of a board whose last line is ``last``; any arithmetic type."""
    if not 0 <= t <= 7:
        raise ValueError(f"no symmetry {t}")
    swap = t in (2, 3, 6, 7)
    flip_first, flip_second = t in (4, 5, 6, 7), t in (1, 2, 4, 7)
    a, b = (y, x) if swap else (x, y)
    return (last - a if flip_first else a), (last - b if flip_second else b)


def letters(x: Column, y: Column) -> Column:
    return F.concat(F.char((x + 97).cast("int")), F.char((y + 97).cast("int")))


def transformed(move: Column, t: int, last: Column | int = 18) -> Column:
    """A move's two letters under symmetry t; moves without a point stay."""
    x, y = mirrored(t, move["x"], move["y"], F.lit(last) if isinstance(last, int) else last)
    return F.when(move["x"].isNull() | move["mv"].isin(*FIXED), move["mv"]).otherwise(letters(x, y))


def human_to_letters(name: str, size: int = 19) -> str:
    """'C14' as 'cf': columns skip I, rows count from the bottom."""
    column, row = name[:1].upper(), name[1:]
    if not column.isalpha() or column == "I" or not row.isdigit() or not 1 <= int(row) <= size:
        raise ValueError(f"not a point: {name!r}")
    x = ord(column) - ord("A") - (column > "I")
    if x >= size:
        raise ValueError(f"not a point: {name!r}")
    return chr(97 + x) + chr(97 + size - int(row))


def letters_to_human(mv: str, size: int = 19) -> str:
    x, y = ord(mv[0]) - 97, ord(mv[1]) - 97
    return chr(ord("A") + x + (x >= 8)) + str(size - y)


def parse_point(text: str, size: int = 19) -> str:
    """Either spelling of a point, as two letters."""
    if len(text) == 2 and text.isalpha() and text.islower():
        return text
    return human_to_letters(text, size)


def swapped(color: Column) -> Column:
    return F.when(color == "B", "W").when(color == "W", "B").otherwise(color)


#: Names of the reflections.
FLIPS = {"vflip": 1, "bflip": 3, "hflip": 5, "dflip": 7}


def symmetry(name: str) -> int:
    """A symmetry's number by name: vflip, bflip, hflip, dflip; rot with degrees or quarter turns (one if none)."""
    if name in FLIPS:
        return FLIPS[name]
    turns = int(name.removeprefix("rot") or 1) if name.startswith("rot") else None
    if turns is None:
        raise ValueError(f"no such symmetry: {name!r}")
    return 2 * ((turns // 90 if turns % 90 == 0 else turns) % 4)
