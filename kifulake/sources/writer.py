"""Writing records: serialised text, one file a game, and the Parquet database of replayed games."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bitmap import COLUMNS as BITS
from ..operators.bitmap import point_words
from ..operators.board import EVENT, with_plays
from ..operators.moves import truncated
from .index import BLOOM, signed

#: Properties that stay on the line of their move, which they end.
INLINE = ("BL", "WL", "OB", "OW", "CR")


def _shown(p: dict) -> str:
    return p["id"] + "".join(f"[{v}]" for v in p["vals"])


def _node(props: list[dict], used: int, per_line: int) -> tuple[str, int]:
    """A node's text, and the moves on the line that it leaves; used: those before it."""
    out, rest, lines = ";", props, False
    if props and props[0]["id"] in ("B", "W") and len(props[0]["vals"]) == 1:
        out, used = ("\n;", 1) if used >= per_line else (";", used + 1)
        out, rest = out + _shown(props[0]), props[1:]
    for p in rest:
        if p["id"] in INLINE:
            out, used = out + _shown(p), per_line
        else:
            out, used, lines = out + ("" if lines else "\n") + _shown(p) + "\n", 0, True
    return out, used


def serialised(nodes: list[dict], per_line: int = 10) -> str:
    """A record's text: root properties one a line and a blank line, moves ten a line,
    other properties on lines of their own, variations in brackets."""
    if not nodes:
        return "(;)\n"
    children: dict[int, list[int]] = {}
    for n in nodes:
        children.setdefault(n["parent"], []).append(n["node_id"])
    by_id, out, used = {n["node_id"]: n for n in nodes}, [], 0
    todo: list = [("open", r) for r in reversed(children.get(-1, []))]
    while todo:
        what, at = todo.pop()
        if what == "close":
            out.append(")\n")
            used = 0
            continue
        if what == "open":
            out.append("(")
            todo.append(("close", at))
        body, used = _node(by_id[at]["props"], used, per_line)
        out.append(body + "\n" if by_id[at]["parent"] == -1 else body)
        next_ = children.get(at, [])
        todo += [("go", next_[0])] if len(next_) == 1 else [("open", c) for c in reversed(next_)]
    return "".join(out)


def text(nodes: Column, per_line: int = 10) -> Column:
    """An array of nodes as a record's text."""

    @F.arrow_udf("string")
    def udf(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else serialised(x, per_line) for x in a.to_pylist()], pa.string())

    return udf(nodes)


def write_games(games: DataFrame, to: str, name: Column | None = None) -> None:
    """Records as text, one folder for each value of ``name`` (the digest of the path by default)."""
    named = games.select((F.md5("path") if name is None else name).alias("name"), text(F.col("nodes")).alias("value"))
    named.write.partitionBy("name").text(to)


#: What the database holds of a game: enough for every query but those on properties.
COLUMNS = ("game_id", "path", "game_nr", "size", "abct", "awct", "setup", "movect", "black_captured", "white_captured", "md5", "can", "canx", "black", "white", "moves", "events")


def write_database(games: DataFrame, to: str, mode: str = "errorifexists") -> None:
    """Replayed games as Parquet; readers prune columns and skip row groups by statistics and,
    for signatures, Bloom filters. Points ever black and white are bits of their own."""
    g = with_plays(games).where("parse_error is null")
    caught = lambda c: F.size(F.filter("plays.events", lambda e: e["is_capture"] & (e["color"] == c)))
    g = g.withColumns({"movect": F.size("moves") - F.col("setup"), "black_captured": caught("B"), "white_captured": caught("W"), "events": F.col("plays.events").cast(f"array<{EVENT}>")})
    g = g.withColumns({**signed(F.col("moves"), F.col("size")), **{c: point_words(F.col("moves"), k) for k, c in BITS.items()}})
    g.select(*COLUMNS).sortWithinPartitions("movect").write.mode(mode).options(**BLOOM).parquet(to)


def read_database(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def moves_from_events(events: Column) -> Column:
    """The move array again: every event that takes nothing off."""
    played = F.filter(events, lambda e: ~e["is_capture"])
    letters = lambda e: F.when(e["is_pass"], "tt").otherwise(F.concat(F.char((e["x"] + 97).cast("int")), F.char((e["y"] + 97).cast("int"))))
    return F.transform(played, lambda e: F.struct(e["color"].alias("color"), e["x"].alias("x"), e["y"].alias("y"), letters(e).alias("mv")))


__all__ = ["moves_from_events", "read_database", "serialised", "text", "truncated", "write_database", "write_games"]
