"""Pattern search: the first move after which all constraints hold.

Constraints name points that must be black, white or empty. Each event at such a point
meets or breaks its constraint; a running sum over the events in order counts those that
hold. Matching is by event: it may happen once a stone is set and before what it captures
is taken off. Points that no event has touched are empty from the start, so a pattern of
empty points alone matches at move 0; a repeated constraint counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.points import mirrored
from ..sources.sgf import area, board_size, parse

WANT = {"AB": "B", "B": "B", "AW": "W", "W": "W", "AE": "E"}


def constraints(pattern: str) -> tuple[int, list[tuple[int, int, str]]]:
    """(size, points with what they must be) of a record of one line of nodes."""
    game = parse(pattern)[0]
    if game["parse_error"] or any(not n["is_main"] for n in game["nodes"]):
        raise ValueError("a pattern is one record without variations")
    props = [(p["id"], p["vals"]) for n in game["nodes"] for p in n["props"]]
    size, want = board_size(props), {}
    for name, vals in props:
        if name in WANT:
            for v in vals:
                points = area(v, size)
                if not points:
                    raise ValueError(f"not a point of a pattern: {v!r}")
                want.update(((x, y), WANT[name]) for x, y in points)
        elif name not in ("SZ", "GM", "FF"):
            raise ValueError(f"{name} can't be in a pattern")
    return size, [(x, y, c) for (x, y), c in sorted(want.items())]


def variants(pattern: list[tuple[int, int, str]], last: int, all_symmetries: bool = False, swap: bool = False) -> list[tuple[int, int, int, int, str]]:
    """(symmetry, swapped, x, y, want) rows; at most 16 times the pattern's points."""
    flip = {"B": "W", "W": "B", "E": "E"}
    return [(t, s, *mirrored(t, x, y, last), flip[c] if s else c) for t in (range(8) if all_symmetries else (0,)) for s in ((0, 1) if swap else (0,)) for x, y, c in pattern]


def first_match(events: DataFrame, rows: list[tuple[int, int, int, int, str]], key: str = "game_id", order: str = "ev") -> DataFrame:
    """(key, first_move, tra, swapped) of the games that match: the least move, then variant.

    events: key, order, move_nr, color, x, y, is_capture. The pattern is at most 16 * 361
    rows, so it is broadcast; the window runs over the events at pattern points alone.
    """
    spark = events.sparkSession
    want = spark.createDataFrame(rows, "tra int, swapped int, px int, py int, want string")
    needed = want.groupBy("tra", "swapped").agg(F.count_if(F.col("want") != "E").alias("need"))
    hits = events.where("x is not null").join(F.broadcast(want), (F.col("x") == F.col("px")) & (F.col("y") == F.col("py")))
    w = Window.partitionBy(key, "tra", "swapped").orderBy(order)
    here = Window.partitionBy(key, "tra", "swapped", "x", "y").orderBy(order)
    now = F.when(F.col("is_capture"), "E").otherwise(F.col("color"))
    holds = (now == F.col("want")).cast("int")
    before = F.coalesce(F.lag(holds).over(here), (F.col("want") == "E").cast("int"))
    stepped = hits.withColumn("delta", holds - before)
    total = want.groupBy("tra", "swapped").agg(F.count("*").alias("points")).join(needed, ["tra", "swapped"]).withColumnsRenamed({"tra": "t", "swapped": "s"})
    running = stepped.withColumn("run", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    running = running.join(F.broadcast(total), (F.col("tra") == F.col("t")) & (F.col("swapped") == F.col("s"))).where(F.col("run") == F.col("need"))
    found = running.select(key, F.struct(F.col("move_nr"), "tra", "swapped").alias("m"))
    if empty := [(t, s) for t, s in {(r[0], r[1]) for r in rows} if all(r[4] == "E" for r in rows if r[:2] == (t, s))]:
        at0 = events.select(key).distinct().crossJoin(F.broadcast(spark.createDataFrame(empty, "tra int, swapped int")))
        found = found.union(at0.select(key, F.struct(F.lit(0).alias("move_nr"), "tra", "swapped")))
    return found.groupBy(key).agg(F.min("m").alias("m")).select(key, F.col("m.move_nr").alias("first_move"), "m.tra", "m.swapped")
