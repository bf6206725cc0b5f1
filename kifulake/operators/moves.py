"""Projections of move arrays: listings, slices, truncation, searches."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.points import mirrored, parse_point, swapped, transformed
from .bitmap import holds


def truncated(moves: Column, keep: int | None = None, drop: int | None = None, setup: Column | int = 0) -> Column:
    """The first ``keep`` moves, or all but the last ``drop``; setup stones, which come first, stay."""
    setup = F.lit(setup) if isinstance(setup, int) else setup
    n = F.lit(keep) + setup if keep is not None else F.greatest(F.size(moves) - F.lit(drop or 0), setup)
    return F.slice(moves, 1, F.greatest(n, F.lit(0)))


def without_trailing_passes(moves: Column) -> Column:
    """Moves up to the last that isn't a pass."""
    ends = F.filter(F.transform(moves, lambda m, i: F.when(m["mv"] != "tt", i + 1)), lambda i: i.isNotNull())
    return F.slice(moves, 1, F.coalesce(F.array_max(ends), F.lit(0)))


def with_symmetry(moves: Column, t: int, last: Column | int = 18) -> Column:
    end = F.lit(last) if isinstance(last, int) else last

    def one(m):
        x, y = mirrored(t, m["x"], m["y"], end)
        return F.struct(m["color"].alias("color"), x.cast("int").alias("x"), y.cast("int").alias("y"), transformed(m, t, end).alias("mv"))

    return F.transform(moves, one)


def colors_swapped(moves: Column) -> Column:
    return F.transform(moves, lambda m: F.struct(swapped(m["color"]).alias("color"), m["x"].alias("x"), m["y"].alias("y"), m["mv"].alias("mv")))


def ranges(text: str) -> list[tuple[int, int | None]]:
    """'3,5-7,9-' as (first, last) pairs; None: to the end."""
    out = []
    for part in text.split(","):
        m = re.fullmatch(r"(\d+)(-(\d*))?", part.strip())
        if not m:
            raise ValueError(f"not a list of moves: {text!r}")
        out.append((int(m[1]), (int(m[3]) if m[3] else None) if m[2] else int(m[1])))
    return out


def listed(moves: Column, spec: str | None = None, numbered: bool = False, colored: bool = False, setup: Column | int = 0) -> Column:
    """Moves as an array of strings: letters, or 'B[pd]' (colored), after '12. ' (numbered).

    spec: which moves, counted after the setup stones; one that isn't there is '??'.
    """
    setup = F.lit(setup) if isinstance(setup, int) else setup

    def shown(m, i):
        mv = F.coalesce(m["mv"], F.lit("??"))
        body = F.concat(F.coalesce(m["color"], F.lit("X")), F.lit("["), mv, F.lit("]")) if colored else mv
        return F.concat((i + 1).cast("string"), F.lit(". "), body) if numbered else body

    played = F.slice(moves, setup + 1, F.greatest(F.size(moves) - setup, F.lit(0)))
    if spec is None:
        return F.transform(played, shown)
    parts = []
    for a, b in ranges(spec):
        ks = F.sequence(F.lit(a), F.lit(b)) if b is not None else F.when(F.size(played) >= a, F.sequence(F.lit(a), F.size(played))).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(ks, lambda k: shown(F.get(played, k - 1), k - 1)))
    return F.concat(*parts)


@dataclass(frozen=True)
class Wanted:
    """A point that must have been played: by any colour, at any move, if not said otherwise."""

    mv: str
    first: int | None = None
    last: int | None = None
    color: str | None = None


def every(moves: Column, setup: Column, which: str = "", what: str = "") -> Column:
    """All moves as numbered lines. which: "" (moves), I (initial stones) or A (both);
    what: "" (letters), c (the colour alone) or x (colour and letters)."""
    n = F.size(moves)
    first = setup if which == "" else F.lit(0)
    chosen = F.slice(moves, first + 1, F.greatest((setup if which == "I" else n) - first, F.lit(0)))
    color = lambda m: F.coalesce(m["color"], F.lit("X"))
    body = {"": lambda m: m["mv"], "c": color, "x": lambda m: F.concat(color(m), m["mv"])}[what]
    return F.array_join(F.transform(chosen, lambda m, i: F.concat((i + 1).cast("string"), F.lit(". "), body(m))), "\n")


def positions(text: str, color: str | None = None, size: int = 19) -> list[Wanted]:
    """'cf,dd' or 'C14:1-20,dd': a range holds for the items after it too."""
    out, lo, hi = [], None, None
    for part in text.split(","):
        name, _, span = part.strip().partition(":")
        if span:
            ((lo, hi),) = ranges(span)
        out.append(Wanted(parse_point(name, size), lo, hi, color))
    return out


def played(moves: Column, wanted: list[Wanted], setup: Column | int = 0) -> Column:
    """True where each wanted point occurs; setup stones have number 0."""
    setup = F.lit(setup) if isinstance(setup, int) else setup

    def fits(w: Wanted):
        def one(m, i):
            nr = F.greatest(i + 1 - setup, F.lit(0))
            ok = m["mv"] == w.mv
            if w.color:
                ok = ok & (m["color"] == w.color)
            if w.first is not None:
                ok = ok & (nr >= w.first)
            if w.last is not None:
                ok = ok & (nr <= w.last)
            return ok

        return F.exists(F.transform(moves, one), lambda b: b)

    out = F.lit(True)
    for w in wanted:
        out = out & fits(w)
    return out


def played_bits(black: Column, white: Column, wanted: list[Wanted]) -> tuple[Column, list[Wanted]]:
    """As played, from the points' bits: a test that all games must pass, and what it leaves
    open, which the moves must tell: those with a range, and passes."""
    out, rest = F.lit(True), []
    for w in wanted:
        if len(w.mv) != 2 or w.mv == "tt":
            rest.append(w)
            continue
        point = [(ord(w.mv[0]) - 97, ord(w.mv[1]) - 97)]
        sides = {"B": [black], "W": [white]}.get(w.color, [black, white])
        hit = holds(sides[0], point)
        for side in sides[1:]:
            hit = hit | holds(side, point)
        out = out & hit
        if w.first is not None or w.last is not None:
            rest.append(w)
    return out, rest


def exploded(games: DataFrame, key: str = "game_id") -> DataFrame:
    """A row for each move: k from 1."""
    return games.select(key, F.posexplode("moves").alias("i", "m")).select(key, (F.col("i") + 1).alias("k"), "m.color", "m.x", "m.y", "m.mv")
