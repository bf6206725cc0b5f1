"""Merging records of one game from several collections, as many as there are.

Sources come as rows: a key that says which game it is, their place in the order, their
nodes. Each is made a straight line first; then moves, properties and lengths are rows, and
grouped minima keep of each position, and of each property, the first source's. What a group
gathers is as long as a game and its different properties, however many sources agree.

Moves are compared by their letters; a last node without a move gives its properties alone.
The first source's move counts where they differ, and the longest one's tail, unless it is
passes alone; both are noted. Equal notes of several sources come once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sgf import NODE
from .compare import joined_notes

SETUP = ("AB", "AW", "AE")
STEP = "struct<color:string,mv:string>"


def _is_move(p: Column) -> Column:
    return p["id"].isin("B", "W")


def _letters(value: Column) -> Column:
    """A move's letters: nothing is a pass, white space around two letters goes."""
    bare = F.regexp_replace(value, r"[ \r\n]", "")
    return F.when(F.coalesce(value, F.lit("")) == "", "tt").when(F.length(bare) == 2, bare).otherwise(value)


def prepared(nodes: Column) -> Column:
    """A record as struct(head, moves, tail, n): variations gone, properties kept in the root and
    the last node alone, setup stones before the first move moved to the root. n: nodes behind the root."""
    main = F.filter(nodes, lambda n: n["is_main"])

    def shaped(main: Column) -> Column:
        moved = lambda n: F.exists(n["props"], _is_move)
        size = F.size(main)
        rest = F.slice(main, 2, F.greatest(size - 1, F.lit(0)))
        inner = F.slice(main, 2, F.greatest(size - 2, F.lit(0)))
        first = F.coalesce(F.array_min(F.filter(F.transform(inner, lambda n, i: F.when(moved(n), i)), lambda i: i.isNotNull())), F.size(inner))
        hoisted = F.flatten(F.transform(F.slice(inner, 1, first), lambda n: F.filter(n["props"], lambda p: p["id"].isin(*SETUP))))
        step = lambda n: F.get(F.filter(n["props"], _is_move), F.lit(0))
        moves = F.transform(F.filter(rest, moved), lambda n: F.struct(step(n)["id"].alias("color"), _letters(F.get(step(n)["vals"], F.lit(0))).alias("mv")))
        last = F.get(main, size - 1)["props"]
        at = F.array_position(F.transform(last, lambda p: _is_move(p)), True).cast("int")
        tail = F.when(size > 1, F.when(at > 0, F.concat(F.slice(last, 1, F.greatest(at - 1, F.lit(0))), F.slice(last, at + 1, F.size(last)))).otherwise(last))
        none = F.slice(last, 1, 0)
        return F.struct(F.concat(F.coalesce(F.get(main, F.lit(0))["props"], none), hoisted).alias("head"), moves.alias("moves"), F.coalesce(tail, none).alias("tail"), (size - 1).alias("n"))

    return F.get(F.transform(F.array(main), shaped), F.lit(0))


def _properties(rows: DataFrame, name: str, key: str) -> DataFrame:
    """Each different property of a key's sources, in the order in which they first come."""
    ordered = lambda p: F.when(p["id"].isin(*SETUP), F.array_sort(F.array_distinct(p["vals"]))).otherwise(p["vals"])
    each = rows.select(key, "place", F.posexplode(F.col(name)).alias("i", "p")).select(key, F.col("p.id").alias("id"), ordered(F.col("p")).alias("vals"), F.struct("place", "i").alias("at"))
    first = each.groupBy(key, "id", "vals").agg(F.min("at").alias("at"))
    held = F.transform(F.array_sort(F.collect_list(F.struct("at", "id", "vals"))), lambda p: F.struct(p["id"].alias("id"), p["vals"].alias("vals")))
    return first.groupBy(key).agg(held.alias(name))


def _results(props: Column) -> Column:
    """Without results that say less than another: B+ beside B+R."""
    said = lambda p: F.when((p["id"] == "RE") & (F.size(p["vals"]) == 1), F.get(p["vals"], F.lit(0)))
    less = lambda p: F.length(said(p)).eqNullSafe(2) & F.exists(props, lambda q: F.coalesce(F.startswith(said(q), said(p)) & (F.length(said(q)) > 2), F.lit(False)))
    return F.filter(props, lambda p: ~(less(p) & said(p).endswith("+")))


def repeated_ids(props: Column) -> Column:
    """Names that a node has twice or more."""
    names = F.transform(props, lambda p: p["id"])
    return F.array_distinct(F.filter(names, lambda n: F.size(F.filter(names, lambda m: m == n)) > 1))


def merged(sources: DataFrame, key: str = "key", most: int = 0, unique: bool = False, triangles: bool = False) -> DataFrame:
    """A row for each key: n_sources, head, moves, tail, differences, error, nodes.

    sources: key, place (which orders a key's sources), nodes. most: moves that may differ.
    unique: two properties of one name in the root or the last node are an error. triangles:
    TR on the last move goes from the last node; on another point it is an error. error: what
    forbids the merge, else null; nodes: the merged record, its notes in a GC of the root.
    """
    shaped = sources.select(key, "place", prepared(F.col("nodes")).alias("g")).select(key, "place", "g.*")
    rows = shaped.select(key, "place", F.posexplode("moves").alias("i", "m"))
    variants = rows.groupBy(key, "i", "m").agg(F.min("place").alias("place"))
    at = variants.groupBy(key, "i").agg(F.array_sort(F.collect_list(F.struct("place", "m"))).alias("v"))
    step = F.struct("i", F.col("v")[0]["m"].alias("m"), F.transform(F.slice("v", 2, F.size("v")), lambda v: v["m"]).alias("others"))
    moves = at.groupBy(key).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    lengths = shaped.groupBy(key).agg(F.count("*").alias("n_sources"), F.min_by(F.size("moves"), "place").alias("own"), F.min("place").alias("first"), F.array_sort(F.collect_set(F.size("moves"))).alias("lengths"))
    # of sources behind the first, a single node behind the root has been merged with the heads
    ends = shaped.join(lengths.select(key, "first"), key).where((F.col("place") == F.col("first")) | (F.col("n") > 1))
    every = lengths.join(moves, key, "left").join(_properties(shaped, "head", key), key, "left").join(_properties(ends, "tail", key), key, "left")

    none = F.array().cast("array<struct<i:int,m:" + STEP + ",others:array<" + STEP + ">>>")
    bare = F.array().cast("array<struct<id:string,vals:array<string>>>")
    steps = F.coalesce("steps", none)
    played = F.array_max(F.filter(F.transform(steps, lambda s: F.when(s["m"]["mv"] != "tt", s["i"] + 1)), lambda i: i.isNotNull()))
    every = every.withColumn("steps", F.slice(steps, 1, F.greatest("own", F.coalesce(played, F.lit(0)))))
    differing = F.flatten(F.transform("steps", lambda s: F.transform(s["others"], lambda o: F.struct((s["i"] + 1).alias("k"), o["color"].alias("color"), o["mv"].alias("mv"), (o["color"] != s["m"]["color"]).alias("clash")))))
    every = every.withColumns({"head": _results(F.coalesce("head", bare)), "tail": F.coalesce("tail", bare), "differing": differing, "moves": F.transform("steps", lambda s: s["m"])})
    more = lambda n: F.exists(F.slice(F.col("moves"), n + 1, F.greatest(F.size("moves") - n, F.lit(0))), lambda m: m["mv"] != "tt")
    shorter = F.filter("lengths", lambda n: (n < F.size("moves")) & more(n))
    notes = F.concat(
        F.transform("differing", lambda d: F.concat(F.lit("Some sources have "), d["color"], F.lit(" "), d["k"].cast("string"), F.lit(" at "), d["mv"])),
        F.transform(shorter, lambda n: F.concat(F.lit("Some sources have "), n.cast("string"), F.lit(" moves"))),
    )
    last = F.get("moves", F.size("moves") - 1)["mv"]
    stray = F.exists(F.filter("tail", lambda p: p["id"] == "TR"), lambda p: ~F.coalesce((F.size(p["vals"]) == 1) & (F.get(p["vals"], F.lit(0)) == last), F.lit(False)))
    error = F.when(F.exists("differing", lambda d: d["clash"]), "different colors").when(F.size("differing") > most, "different moves" if most == 0 else "too many differences")
    tail = F.col("tail")
    if triangles:
        error, tail = error.when(stray, "triangle off the last move"), F.filter("tail", lambda p: p["id"] != "TR")
    if unique:
        error = error.when((F.size(repeated_ids(F.col("head"))) > 0) | (F.size(repeated_ids(tail)) > 0), "duplicate property")
    every = every.withColumns({"error": error, "tail": tail, "notes": notes})
    return every.select(key, "n_sources", "head", "moves", "tail", F.transform("differing", lambda d: F.struct(d["k"].alias("k"), d["color"].alias("color"), d["mv"].alias("mv"))).alias("differences"), "notes", "error", F.when(F.col("error").isNull(), record("head", "moves", "tail", "notes")).alias("nodes"))


def record(head: str, moves: str, tail: str, notes: str) -> Column:
    """The nodes of a merged game, for writer.text."""
    prop = lambda name, vals: F.struct(name.alias("id"), vals.alias("vals"))
    said = F.when(F.size(notes) > 0, F.array(prop(F.lit("GC"), F.array(joined_notes(F.col(notes)))))).otherwise(F.slice(F.col(head), 1, 0))

    def node(i: Column, props: Column) -> Column:
        values = (i, i - 1, F.lit(0), F.lit(1), F.lit(1), F.lit(True), F.lit(0), props)
        return F.struct(*[v.alias(n) for v, n in zip(values, ("node_id", "parent", "depth", "var_lo", "var_hi", "is_main", "line", "props"), strict=True)])

    n = F.size(moves)
    played = F.transform(moves, lambda m, i: node(i + 1, F.when(i == n - 1, F.concat(F.array(prop(m["color"], F.array(m["mv"]))), F.col(tail))).otherwise(F.array(prop(m["color"], F.array(m["mv"]))))))
    alone = F.when((n == 0) & (F.size(tail) > 0), F.array(node(F.lit(1), F.col(tail)))).otherwise(F.slice(played, 1, 0))
    return F.concat(F.array(node(F.lit(0), F.concat(F.col(head), said))), played, alone).cast(f"array<{NODE}>")
