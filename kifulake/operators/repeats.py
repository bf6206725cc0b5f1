"""Whole-board repetition from stored events: no game is replayed.

A position is the exclusive or of a number for each of its stones; an event puts a stone's
number in or takes it out. So a running exclusive or over a game's events gives every
position, and equal numbers are equal positions (but for a chance of one in 2^64 a pair).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stone(x: Column, y: Column, color: Column) -> Column:
    """The number of a stone on a point."""
    return F.xxhash64(x.cast("long"), y.cast("long"), color)


def positions(events: DataFrame, key: str = "game_id", order: str = "ev") -> DataFrame:
    """key, move_nr, position after each move that sets a stone; 0 is the empty board.

    events: key, order, move_nr, color, x, y, is_pass of stones set and taken off; and
    replaces, where known: the colour that a stone puts out (a board where points are
    played again), else null or no such column."""
    change = stone(F.col("x"), F.col("y"), F.col("color"))
    if "replaces" in events.columns:
        change = change.bitwiseXOR(F.when(F.col("replaces").isNull(), F.lit(0).cast("long")).otherwise(stone(F.col("x"), F.col("y"), F.col("replaces"))))
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = events.where("not is_pass").select(key, order, "move_nr", F.bit_xor(change).over(w).alias("p"))
    return running.groupBy(key, "move_nr").agg(F.max_by("p", order).alias("position")).where("move_nr > 0")


def repeated(events: DataFrame, key: str = "game_id", order: str = "ev") -> DataFrame:
    """key, move_nr: each move after which the board is empty, or as after an earlier move."""
    w = Window.partitionBy(key, "position").orderBy("move_nr")
    seen = positions(events, key, order).withColumn("n", F.row_number().over(w))
    return seen.where((F.col("n") > 1) | (F.col("position") == 0)).select(key, "move_nr")


def first_repeat(events: DataFrame, key: str = "game_id", order: str = "ev") -> DataFrame:
    """key, cycle_move: the first such move of the games that have one, as the replay finds it."""
    return repeated(events, key, order).groupBy(key).agg(F.min("move_nr").alias("cycle_move"))
