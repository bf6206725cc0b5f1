"""What two games share, as chunks: gaps and islands over rows, no move read twice by a program.

A chunk both games have grows around a move that each has once (an anchor): the moves before
and after it, as long as they are equal. On rows that is an island of equal moves at one
distance k1 - k2, with an anchor in it. Islands come in the order of their first anchors; one
that reaches back into the island before gives way to it. What no island covers is in one game alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.points import letters_to_human


def _rows(pairs: DataFrame, side: str, key: str, k: str) -> DataFrame:
    """key, k (from 1), mv; moves without a point are all passes."""
    each = pairs.select(key, F.posexplode(F.transform(side, lambda m: F.when(m["x"].isNull(), "tt").otherwise(m["mv"]))).alias("i", "mv"))
    return each.select(key, (F.col("i") + 1).alias(k), "mv")


def common(pairs: DataFrame, key: str = "pair", a: str = "a", b: str = "b") -> DataFrame:
    """key, k1, k2, length of the chunks that both games have, in the first one's order."""
    first, second = _rows(pairs, a, key, "k1"), _rows(pairs, b, key, "k2")
    once = lambda rows, k: rows.groupBy(key, "mv").agg(F.count("*").alias("n"), F.min(k).alias(k)).where("n = 1").select(key, "mv", k)
    anchors = once(first, "k1").join(once(second, "k2"), [key, "mv"]).select(key, (F.col("k1") - F.col("k2")).alias("d"), "k1", F.lit(1).alias("anchor"))
    # only the distances at which some anchor lies are looked at
    along = first.join(anchors.select(key, "d").distinct(), key).withColumn("k2", F.col("k1") - F.col("d"))
    equal = along.join(second, [key, "k2", "mv"]).join(anchors, [key, "d", "k1"], "left")
    islands = equal.withColumn("island", F.col("k1") - F.row_number().over(Window.partitionBy(key, "d").orderBy("k1")))
    whole = islands.groupBy(key, "d", "island").agg(F.min("k1").alias("start"), F.max("k1").alias("end"), F.min(F.when(F.col("anchor") == 1, F.col("k1"))).alias("at")).where("at is not null")
    start = F.greatest("start", F.coalesce(F.lag("end").over(Window.partitionBy(key).orderBy("at")) + 1, F.lit(1)))
    return whole.withColumn("k1", start).select(key, "k1", (F.col("k1") - F.col("d")).alias("k2"), (F.col("end") - F.col("k1") + 1).alias("length"))


def _gaps(covered: DataFrame, sizes: DataFrame, key: str, k: str) -> DataFrame:
    """key, k, length of what of 1 to n the spans (key, k, length) leave uncovered."""
    ends = sizes.select(key, (F.col("n") + 1).alias("k"), F.lit(0).alias("length"))
    spans = covered.select(key, F.col(k).alias("k"), "length").unionByName(ends)
    w = Window.partitionBy(key).orderBy("k", F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    reached = spans.withColumn("from", F.coalesce(F.max(F.col("k") + F.col("length")).over(w), F.lit(1)))
    return reached.where("k > from").select(key, F.col("from").alias(k), (F.col("k") - F.col("from")).alias("length"))


def chunks(pairs: DataFrame, key: str = "pair", a: str = "a", b: str = "b") -> DataFrame:
    """key, type (1: only in the first game, 2: only in the second, 3: in both), k1, k2 (from
    1; null where the chunk isn't in that game), length."""
    both = common(pairs, key, a, b)
    sizes = lambda side: pairs.select(key, F.size(side).alias("n"))
    none = F.lit(None).cast("int")
    shape = lambda df, kind, k1, k2: df.select(key, F.lit(kind).alias("type"), k1.cast("int").alias("k1"), k2.cast("int").alias("k2"), F.col("length").cast("int").alias("length"))
    k1, k2 = F.col("k1"), F.col("k2")
    out = shape(both, 3, k1, k2)
    out = out.unionByName(shape(_gaps(both, sizes(a), key, "k1"), 1, k1, none))
    return out.unionByName(shape(_gaps(both, sizes(b), key, "k2"), 2, none, k2))


def ranges(differing: Column) -> Column:
    """Numbers of differing moves, in order, as '3, 5-7': neighbours make a range."""
    joins = lambda done, k: (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["b"] + 1 == k)
    start = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    one = lambda a, b: F.array(F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")))
    spans = F.aggregate(differing, F.array().cast("array<struct<a:int,b:int>>"), lambda done, k: F.when(joins(done, k), F.concat(start(done), one(F.get(done, F.size(done) - 1)["a"], k))).otherwise(F.concat(done, one(k, k))))
    return F.array_join(F.transform(spans, lambda s: F.concat(s["a"].cast("string"), F.when(s["b"] > s["a"], F.concat(F.lit("-"), s["b"].cast("string"))).otherwise(""))), ", ")


def human(mv: Column, size: int = 19) -> Column:
    """Letters as a board's own names (C14); what is no point stays."""
    names = F.create_map(*[F.lit(x) for i in range(size) for j in range(size) for p in [chr(97 + i) + chr(97 + j)] for x in (p, letters_to_human(p, size))])
    return F.coalesce(F.get(F.array(F.try_element_at(names, mv)), F.lit(0)), mv)


def report(differences: Column, most: int = 12, named: bool = False, size: int = 19) -> Column:
    """Differences (k, m1, m2) as text, a line each: '23: ql rl'; beyond ``most`` their number alone."""
    shown = lambda c: human(c, size) if named else c
    lines = F.transform(F.slice(differences, 1, most), lambda d: F.concat(d["k"].cast("string"), F.lit(": "), shown(d["m1"]), F.lit(" "), shown(d["m2"])))
    more = F.when(F.size(differences) > most, F.array(F.concat((F.size(differences) - most).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(lines, more), "\n")
