"""Walking trees of variations by node intervals: a node is on variation v if var_lo <= v <= var_hi."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .properties import shown


def has_move(n: Column) -> Column:
    return F.exists(n["props"], lambda p: p["id"].isin("B", "W"))


def move_of(n: Column) -> Column:
    p = F.get(F.filter(n["props"], lambda p: p["id"].isin("B", "W")), F.lit(0))
    return F.trim(F.get(p["vals"], F.lit(0)))


def n_variations(nodes: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(nodes, lambda n: n["var_hi"])), F.lit(0))


def on_variation(nodes: Column, v: int | Column) -> Column:
    return F.filter(nodes, lambda n: (n["var_lo"] <= v) & (F.lit(v) <= n["var_hi"]) if isinstance(v, int) else (n["var_lo"] <= v) & (v <= n["var_hi"]))


def n_moves(nodes: Column, v: int = 1) -> Column:
    return F.size(F.filter(on_variation(nodes, v), has_move))


def upto_move(nodes: Column, v: int, m: int) -> Column:
    """The nodes of variation v up to its m-th move, with what follows before the next."""
    line = on_variation(nodes, v)
    count = lambda i: F.size(F.filter(F.slice(line, 1, i + 1), has_move))
    return F.filter(line, lambda n, i: count(i) <= m)


def first_difference(nodes: Column, v: int, w: int) -> Column:
    """The number of the first move at which variations v and w differ."""
    return F.size(F.filter(F.filter(nodes, lambda n: (n["var_lo"] <= min(v, w)) & (n["var_hi"] >= max(v, w))), has_move)) + 1


def moves_with_properties(nodes: Column, v: int = 1) -> Column:
    """Numbers of the moves whose nodes hold more than the move."""
    line = F.filter(on_variation(nodes, v), has_move)
    return F.filter(F.transform(line, lambda n, i: F.when(F.size(n["props"]) > 1, i + 1)), lambda i: i.isNotNull())


def properties_at(nodes: Column, v: int, m: int, name: str | None = None, separator: str = ", ") -> Column:
    """Names (or one property's values) of the m-th move's node of variation v; 0: the nodes before the first."""
    line = on_variation(nodes, v)
    count = lambda i: F.size(F.filter(F.slice(line, 1, i + 1), has_move))
    props = F.flatten(F.transform(F.filter(line, lambda n, i: count(i) == m), lambda n: n["props"]))
    if name is None:
        return F.array_join(F.transform(props, lambda p: p["id"]), " ")
    return F.array_join(F.flatten(F.transform(F.filter(props, lambda p: p["id"] == name), lambda p: p["vals"])), separator)


def replies(nodes: Column, after: list[str] | None = None) -> Column:
    """The moves that the record knows after a path of moves from the root, in the order of
    the record. Nodes without a move are passed through, however many; a move of the root's
    own doesn't count."""
    played = F.array(*[F.lit(m) for m in after or []]).cast("array<string>")
    moved = lambda n: has_move(n) & (n["parent"] != -1)

    def way(n: Column) -> Column:
        """The moves from the root to a node, its own included."""
        on_it = F.filter(nodes, lambda p: moved(p) & (p["node_id"] <= n["node_id"]) & (p["var_lo"] <= n["var_lo"]) & (n["var_hi"] <= p["var_hi"]))
        return F.transform(on_it, move_of)

    found = F.filter(nodes, lambda n: moved(n) & way(n).eqNullSafe(F.concat(played, F.array(move_of(n)))))
    return F.array_distinct(F.transform(found, move_of))


def move_numbers(nodes_rows: DataFrame) -> DataFrame:
    """Of nodes as rows: mv (1 where the node has a move) and nr, the moves on the way to it.

    A walk around the tree opens each node at its first leaf and closes it behind its last;
    one running sum over both gives all ways at once, in proportion to the nodes."""
    from pyspark.sql import Window

    key = ["path", "game_nr"]
    moved = F.exists("props", lambda p: p["id"].isin("B", "W")).cast("int")
    n = nodes_rows.select(*key, "node_id", "depth", "var_lo", "var_hi", moved.alias("mv"))
    open_, close = F.struct(F.col("var_lo").alias("leaf"), F.lit(0).alias("closes"), F.col("mv").alias("step")), F.struct(F.col("var_hi").alias("leaf"), F.lit(1).alias("closes"), (-F.col("mv")).alias("step"))
    walk = n.withColumn("e", F.explode(F.array(open_, close)))
    w = Window.partitionBy(*key).orderBy("e.leaf", "e.closes", "node_id").rowsBetween(Window.unboundedPreceding, 0)
    return walk.withColumn("nr", F.sum("e.step").over(w)).where("e.closes = 0").drop("e")


def tree_rows(nodes_rows: DataFrame) -> DataFrame:
    """Of nodes as rows (with path, game_nr): a row for each run of nodes without a branch,
    indented by depth, as 'first-last' move numbers, in the order of the record."""
    from pyspark.sql import Window

    key = ["path", "game_nr"]
    numbered = move_numbers(nodes_rows)
    w = Window.partitionBy(*key).orderBy("node_id")
    new = F.when((F.lag("var_lo").over(w) == F.col("var_lo")) & (F.lag("var_hi").over(w) == F.col("var_hi")) & (F.lag("depth").over(w) == F.col("depth")), 0).otherwise(1)
    runs = numbered.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    spans = runs.groupBy(*key, "run").agg(F.min("depth").alias("depth"), F.min(F.when(F.col("mv") == 1, F.col("nr"))).alias("first"), F.max(F.when(F.col("mv") == 1, F.col("nr"))).alias("last"))
    label = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.coalesce(F.concat(F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string")), F.lit("-")))
    return spans.select(*key, "run", label.alias("label"))


__all__ = ["first_difference", "has_move", "move_numbers", "move_of", "moves_with_properties", "n_moves", "n_variations", "on_variation", "properties_at", "replies", "shown", "tree_rows", "upto_move"]
