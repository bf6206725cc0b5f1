"""Projections of node properties, as expressions on a game's array of nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_props(nodes: Column, where: str = "all") -> Column:
    """All properties in pre-order; where: all, root, or rest (all but the root)."""
    some = {"all": lambda n: F.lit(True), "root": lambda n: n["node_id"] == 0, "rest": lambda n: n["node_id"] > 0}[where]
    return F.flatten(F.transform(F.filter(nodes, some), lambda n: n["props"]))


def ids(nodes: Column, where: str = "all", moves: bool | None = None) -> Column:
    """Names with repeats, joined by blanks. Moves are left out but for the root."""
    props = all_props(nodes, where)
    if not (where == "root" if moves is None else moves):
        props = F.filter(props, lambda p: ~p["id"].isin("B", "W"))
    return F.array_join(F.transform(props, lambda p: p["id"]), " ")


def multi_ids(nodes: Column, where: str = "all") -> Column:
    """Names of properties with several values, as XY-n."""
    several = F.filter(all_props(nodes, where), lambda p: F.size(p["vals"]) > 1)
    return F.array_join(F.transform(several, lambda p: F.concat(p["id"], F.lit("-"), F.size(p["vals"]).cast("string"))), " ")


def first_value(nodes: Column, name: str, where: str = "all") -> Column:
    """The first value of the first property of that name; null where there is none."""
    return F.get(F.get(F.filter(all_props(nodes, where), lambda p: p["id"] == name), F.lit(0))["vals"], F.lit(0))


def first_all(nodes: Column, name: str, where: str = "all") -> Column:
    """The first property of that name with all its values: XY[a][b]."""
    p = F.get(F.filter(all_props(nodes, where), lambda p: p["id"] == name), F.lit(0))
    return shown(p["id"], p["vals"])


def shown(name: Column, vals: Column) -> Column:
    return F.concat(name, F.array_join(F.transform(vals, lambda v: F.concat(F.lit("["), v, F.lit("]"))), ""))


def one_line(text: Column) -> Column:
    """Line ends as blanks."""
    return F.translate(text, "\n\r", "  ")


def players(black: Column, white: Column) -> Column:
    """'PB,PW'; null where either is."""
    return F.concat(black, F.lit(","), white)


def winner(result: Column, black: Column, white: Column) -> Column:
    return F.when(result.startswith("B+"), black).when(result.startswith("W+"), white)


def loser(result: Column, black: Column, white: Column) -> Column:
    return F.when(result.startswith("B+"), white).when(result.startswith("W+"), black)


def handicap(abct: Column, awct: Column) -> Column:
    """Black setup values, if there is no white one."""
    return F.when(awct > 0, 0).otherwise(abct)
