"""Diagrams as SVG text, from a position and numbered moves: one expression a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL = 24


def _px(c: Column) -> Column:
    return ((c + 1) * CELL).cast("string")


def _grid(size: Column) -> Column:
    end = _px(size - 1)
    lines = lambda a, b: F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.concat(F.lit(f'<line {a}1="{CELL}" {a}2="'), end, F.lit(f'" {b}1="'), _px(i), F.lit(f'" {b}2="'), _px(i), F.lit('" stroke="black"/>'))), "")
    return F.concat(lines("x", "y"), lines("y", "x"))


def _stone(x: Column, y: Column, color: Column, label: Column) -> Column:
    fill = F.when(color == "B", "black").otherwise("white")
    ink = F.when(color == "B", "white").otherwise("black")
    disc = F.concat(F.lit('<circle cx="'), _px(x), F.lit('" cy="'), _px(y), F.lit(f'" r="{CELL * 12 // 25}" stroke="black" fill="'), fill, F.lit('"/>'))
    text = F.concat(F.lit('<text x="'), _px(x), F.lit('" y="'), _px(y), F.lit('" dy="4" text-anchor="middle" font-size="11" fill="'), ink, F.lit('">'), label, F.lit("</text>"))
    return F.when(label == "", disc).otherwise(F.concat(disc, text))


def coordinates(size: Column) -> Column:
    """Column letters (without I) above and row numbers on the left."""
    i = F.sequence(F.lit(0), size - 1)
    top = F.transform(i, lambda k: F.concat(F.lit('<text text-anchor="middle" font-size="11" y="11" x="'), _px(k), F.lit('">'), F.char((k + 65 + F.when(k >= 8, 1).otherwise(0)).cast("int")), F.lit("</text>")))
    left = F.transform(i, lambda k: F.concat(F.lit('<text text-anchor="middle" font-size="11" x="8" y="'), _px(k), F.lit('">'), (size - k).cast("string"), F.lit("</text>")))
    return F.concat(F.array_join(top, ""), F.array_join(left, ""))


def svg(size: Column, stones: Column, played: Column | None = None, coords: bool = False, labels: Column | None = None) -> Column:
    """stones: array of (color, x, y), without numbers; played: array of (nr, color, x, y),
    shown with their numbers above the stones; labels: array of (x, y, text)."""
    board = F.array_join(F.transform(stones, lambda s: _stone(s["x"], s["y"], s["color"], F.lit(""))), "")
    parts = [F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), _px(size), F.lit('" height="'), _px(size), F.lit('">'), _grid(size), board]
    if played is not None:
        parts.append(F.array_join(F.transform(played, lambda m: _stone(m["x"], m["y"], m["color"], m["nr"].cast("string"))), ""))
    if labels is not None:
        parts.append(F.array_join(F.transform(labels, lambda t: F.concat(F.lit('<text text-anchor="middle" x="'), _px(t["x"]), F.lit('" y="'), _px(t["y"]), F.lit('">'), t["text"], F.lit("</text>"))), ""))
    if coords:
        parts.append(coordinates(size))
    return F.concat(*parts, F.lit("</svg>"))


def diagram(size: Column, events: Column, first: int, last: int, coords: bool = False) -> Column:
    """The position before move ``first``, and moves first to last with their numbers."""
    from .board import final_stones

    moves = F.filter(events, lambda e: e["move_nr"].between(first, last) & ~e["is_capture"] & ~e["is_pass"])
    numbered = F.transform(moves, lambda e: F.struct((e["move_nr"] - first + 1).alias("nr"), e["color"].alias("color"), e["x"].alias("x"), e["y"].alias("y")))
    return svg(size, final_stones(events, first - 1), numbered, coords)
