"""Signatures of games from their move arrays: no shuffle, one expression a game."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.points import mirrored, transformed

#: The positions of the usual Dyer signatures.
DYER = {"A": (20, 40, 60), "B": (31, 51, 71)}
DYER["C"] = DYER["AB"] = DYER["A"] + DYER["B"]


def joined(moves: Column, t: int = 0, last: Column | int = 18) -> Column:
    """All moves' letters in a row, under symmetry t."""
    return F.array_join(F.transform(moves, lambda m: transformed(m, t, last)), "")


def md5(moves: Column, t: int = 0, last: Column | int = 18) -> Column:
    """The digest of the letters and a line feed; colours don't count."""
    return F.md5(F.concat(joined(moves, t, last), F.lit("\n")).cast("binary"))


def canonical(moves: Column, extended: bool = False, last: Column | int = 18) -> Column:
    """The least digest over the symmetries; extended: with '-' and the least symmetry that gives it."""
    all8 = [F.concat(md5(moves, t, last), F.lit(f"-{t}")) for t in range(8)]
    least = F.least(*all8)
    return least if extended else F.substring(least, 1, 32)


def at(moves: Column, positions: tuple[int, ...], t: int = 0, last: Column | int = 18) -> Column:
    """The letters at the positions (from 1, setup stones count); '??' beyond the end."""
    parts = [F.get(moves, F.lit(p - 1)) for p in positions]
    return F.concat(*[F.coalesce(transformed(p, t, last), F.lit("??")) for p in parts])


def dyer(moves: Column, kind: str | tuple[int, ...]) -> Column:
    return at(moves, DYER[kind] if isinstance(kind, str) else kind)


def dyer_normalised(moves: Column, kind: str | tuple[int, ...], last: Column | int = 18) -> Column:
    positions = DYER[kind] if isinstance(kind, str) else kind
    return F.least(*[at(moves, positions, t, last) for t in range(8)])


def point_histogram(moves: Column) -> Column:
    """Letters of each move with how often it comes, as a map; colours don't count."""
    mv = F.transform(moves, lambda m: m["mv"])
    return F.map_from_entries(F.transform(F.array_distinct(mv), lambda p: F.struct(p.alias("mv"), F.size(F.filter(mv, lambda q: q == p)).alias("n"))))


__all__ = ["DYER", "at", "canonical", "dyer", "dyer_normalised", "joined", "md5", "mirrored", "point_histogram"]
