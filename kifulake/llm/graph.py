"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and a join back to the
edges, so a vertex that a third of all edges touch never meets in one task: the minimum
is pre-aggregated and AQE splits the join's large partition. Every round is a table in
the shared folder; the driver sees two numbers a round.

Where vertices are 64-bit numbers, each task first puts stars in place of the edges it
holds, ``HELD`` at a time, which connect the same vertices in fewer edges and steps. Edges
that are no more than a task holds at once, which the round's count tells, need no steps at
all: a round is some six shuffles, whatever little it moves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved

#: Edges that a task joins up at once: 4 MB.
HELD = 1 << 18


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of all nodes of these edges but the roots; root: the least node that they connect it to."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(names))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(names)))
    return names[below], names[root[below]]


def _joined(edges: DataFrame, held: int) -> DataFrame:
    """Stars in place of the edges (u, v) of each task."""

    def join(batches):
        u, v = [], []

        def stars_of():
            return stars(np.concatenate([np.zeros(0, "i8"), *u]), np.concatenate([np.zeros(0, "i8"), *v]))

        for batch in batches:
            u.append(batch.column("u").to_numpy(zero_copy_only=False))
            v.append(batch.column("v").to_numpy(zero_copy_only=False))
            if sum(map(len, u)) > held:
                x, y = stars_of()
                u, v = [x], [y]
                if 2 * len(x) > held:
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["u", "v"])
                    u, v = [], []
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars_of()], ["u", "v"])

    return edges.select("u", "v").mapInArrow(join, "u long, v long")


def components(edges: DataFrame, a: str = "a", b: str = "b", held: int = HELD) -> DataFrame:
    """(node, root) of every vertex that has an edge to another; root: its component's least vertex.

    Rows with a null end, loops and repeated edges have no effect; no edges: no rows.
    held: edges that a task joins up at once.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
    numbers = all(kind == "bigint" for _, kind in e.dtypes)
    e = saved(_joined(e, held) if numbers else e.distinct(), "edges")
    seen = None
    while (now := e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != seen:
        seen = now
        if not now[0]:
            break
        if numbers and now[0] <= held:
            before, e = e, saved(_joined(e.coalesce(1), held), "edges")
            discard(before)
            break
        # large-star: all larger neighbours of u go to the least vertex around u
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, both["u"] == low["k"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: u and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        moved = large.join(low, large["u"] == low["k"]).select(F.expr("inline(array(struct(v as u, m as v), struct(u as u, m as v)))"))
        moved = moved.where("u > v").distinct()
        before, e = e, saved(_joined(moved, held) if numbers else moved, "edges")
        discard(before)
    return e.selectExpr("u as node", "v as root").union(e.selectExpr("v as node", "v as root").distinct())
