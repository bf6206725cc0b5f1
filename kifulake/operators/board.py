"""Replaying games: the one operator with state that only a program can carry.

``plays`` is a deterministic Arrow UDF over a game's moves, one row a game, so Catalyst
drops it where no plan field needs it. Everything derived from its events (captures, the
final position, patterns) is built from DataFrame functions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sgf import arrow_type

EVENT = "struct<ev:int,move_nr:int,color:string,x:int,y:int,is_pass:boolean,is_capture:boolean,is_permanent:boolean>"
PLAYS = f"struct<events:array<{EVENT}>,error:string,error_rule:string,cycle_move:int>"
LARGEST = 19


class Illegal(Exception):
    def __init__(self, rule: str, text: str):
        super().__init__(text)
        self.rule = rule


def replay(size: int, moves: list[dict], setup: int, allow_suicide: bool = False) -> dict:
    """The events of a game: stones set, stones taken, passes. Ends at the first illegal move."""
    events: list[list] = []
    error = rule = cycle = None
    stones: dict[tuple[int, int], str] = {}
    chain_of: dict[tuple[int, int], list] = {}
    seen = {frozenset()}
    ko: tuple | None = None
    try:
        if size > LARGEST:
            raise Illegal("size", f"board of {size} lines")
        for i, m in enumerate(moves):
            nr, color, x, y = max(0, i + 1 - setup), m["color"], m["x"], m["y"]
            if x is None:
                if nr and m["mv"] not in ("tt", ""):
                    raise Illegal("syntax", f"move {nr}: {m['mv']!r}")
                events.append([nr, color, None, None, True, False])
                ko = None
                continue
            p = (x, y)
            if not (0 <= x < size and 0 <= y < size):
                raise Illegal("off board", f"move {nr}: {m['mv']}")
            if p in stones:
                raise Illegal("occupied", f"move {nr}: {m['mv']}")
            if nr == 0 and color == "E":
                continue
            events.append([nr, color, x, y, False, False])
            taken = _place(size, stones, chain_of, p, color, allow_suicide, nr, m["mv"])
            for q in taken:
                events.append([nr, "W" if color == "B" else "B", q[0], q[1], False, True])
            if len(taken) == 1 and ko == (taken[0], p):
                raise Illegal("ko", f"move {nr}: {m['mv']}")
            ko = (p, taken[0]) if len(taken) == 1 else None
            if nr:
                board = hash(frozenset(stones.items()))
                if board in seen and cycle is None:
                    cycle = nr
                seen.add(board)
    except Illegal as e:
        error, rule = str(e), e.rule
    last = {(e[2], e[3]): k for k, e in enumerate(events) if not e[4]}
    return {
        "events": [{"ev": k + 1, "move_nr": e[0], "color": e[1], "x": e[2], "y": e[3], "is_pass": e[4], "is_capture": e[5], "is_permanent": not e[4] and last[(e[2], e[3])] == k} for k, e in enumerate(events)],
        "error": error,
        "error_rule": rule,
        "cycle_move": cycle,
    }


def _around(p: tuple[int, int], size: int):
    x, y = p
    for q in ((x, y - 1), (x, y + 1), (x - 1, y), (x + 1, y)):
        if 0 <= q[0] < size and 0 <= q[1] < size:
            yield q


def _place(size, stones, chain_of, p, color, allow_suicide, nr, name) -> list[tuple[int, int]]:
    """Sets a stone and takes what has no liberty left, chain by chain; a chain keeps the order of its stones."""
    stones[p] = color
    chain = [p]
    chain_of[p] = chain
    for q in _around(p, size):
        if stones.get(q) == color and chain_of[q] is not chain:
            other = chain_of[q]
            if len(other) > len(chain):
                chain, other = other, chain
            chain.extend(other)
            for s in other:
                chain_of[s] = chain
    dead: list[tuple[int, int]] = []
    for q in _around(p, size):
        if stones.get(q, color) != color and q not in dead and not _free(chain_of[q], stones, size):
            dead.extend(chain_of[q])
    for s in dead:
        del stones[s], chain_of[s]
    if not dead and not _free(chain, stones, size):
        if not allow_suicide:
            raise Illegal("suicide", f"move {nr}: {name}")
        dead = list(chain)
        for s in dead:
            del stones[s], chain_of[s]
    return dead


def _free(chain, stones, size) -> bool:
    return any(q not in stones for s in chain for q in _around(s, size))


def plays(size: Column, moves: Column, setup: Column, allow_suicide: bool = False) -> Column:
    shape = arrow_type(PLAYS)

    @F.arrow_udf(PLAYS)
    def udf(s: pa.Array, m: pa.Array, i: pa.Array) -> pa.Array:
        return pa.array([replay(a, b or [], c or 0, allow_suicide) for a, b, c in zip(s.to_pylist(), m.to_pylist(), i.to_pylist(), strict=True)], shape)

    return udf(size, moves, setup)


def with_plays(games: DataFrame, allow_suicide: bool = False) -> DataFrame:
    return games.withColumn("plays", plays(F.col("size"), F.col("moves"), F.col("setup"), allow_suicide))


def captured(events: Column, color: str | None = None, upto: int | None = None) -> Column:
    """Stones of the colour (of both) that were taken, by default in the whole game."""
    hit = lambda e: e["is_capture"] & (F.lit(True) if color is None else e["color"] == color) & (F.lit(True) if upto is None else e["move_nr"] <= upto)
    return F.size(F.filter(events, hit))


def final_stones(events: Column, upto: int | None = None) -> Column:
    """The stones on the board after a move (default: the last), as (color, x, y) by x, then y."""
    if upto is None:
        standing = F.filter(events, lambda e: e["is_permanent"] & ~e["is_capture"])
    else:
        now = F.filter(events, lambda e: (e["move_nr"] <= upto) & ~e["is_pass"])
        # the replay is a UDF, so the inner function must not name it again
        left = lambda es: F.filter(es, lambda e: ~e["is_capture"] & ~F.exists(es, lambda f: (f["x"] == e["x"]) & (f["y"] == e["y"]) & (f["ev"] > e["ev"])))
        standing = F.get(F.transform(F.array(now), left), 0)
    return F.transform(F.array_sort(F.transform(standing, lambda e: F.struct(e["x"].alias("x"), e["y"].alias("y"), e["color"].alias("color")))), lambda e: e)


def position_sgf(stones: Column, size: Column) -> Column:
    """A position as a record of one node; the usual size of 19 isn't stated."""
    side = lambda name, color: F.when(F.exists(stones, lambda s: s["color"] == color), F.concat(F.lit(name), F.array_join(F.transform(F.filter(stones, lambda s: s["color"] == color), lambda s: F.concat(F.lit("["), F.char((s["x"] + 97).cast("int")), F.char((s["y"] + 97).cast("int")), F.lit("]"))), ""))).otherwise("")
    stated = F.when(size == 19, "").otherwise(F.concat(F.lit("SZ["), size.cast("string"), F.lit("]")))
    return F.concat(F.lit("(;"), stated, side("AB", "B"), side("AW", "W"), F.lit(")"))


def exploded_plays(games: DataFrame, key: str = "game_id") -> DataFrame:
    """A row for each event; needs with_plays."""
    return games.select(key, F.explode("plays.events").alias("e")).select(key, "e.*")


def last_events(moves: DataFrame, key: str = "game_id", order: str = "k") -> DataFrame:
    """Of events as rows, the last at each point: a grouped maximum, combined before the shuffle."""
    return moves.where("x is not null").groupBy(key, "x", "y").agg(F.max(F.struct(order, "color")).alias("e")).select(key, "x", "y", f"e.{order}", "e.color")


def lagged(moves: DataFrame, key: str = "game_id") -> DataFrame:
    w = Window.partitionBy(key).orderBy("k")
    return moves.withColumn("previous_color", F.lag("color").over(w))
