"""An index of signatures: where each game of a collection is, bucketed by its canonical digest.

A look-up of one canonical signature reads one bucket's files; one of a plain digest skips
the row groups whose Bloom filters don't have it. Equal games share a bucket, so finding
repeats, or the games of a reference collection, shuffles no game.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import signatures

COLUMNS = ("can", "canx", "md5", "game_id", "path", "game_nr", "movect")
KIND = "can string, canx string, md5 string, game_id string, path string, game_nr int, movect int"
BUCKETS = 64
#: Writer options: Bloom filters as large as their column needs, which Parquet leaves out where it has a dictionary.
BLOOM = {f"parquet.{k}#{c}": v for c in ("md5", "can") for k, v in (("bloom.filter.enabled", "true"), ("enable.dictionary", "false"))} | {"parquet.bloom.filter.adaptive.enabled": "true"}


def signed(moves: Column, size: Column) -> dict[str, Column]:
    """The signatures of a game, by name."""
    both = signatures.canonical(moves, True, size - 1)
    return {"md5": signatures.md5(moves), "can": F.substring(both, 1, 32), "canx": both}


def _table(spark: SparkSession, path: str, buckets: int) -> str:
    name = f"kifulake_{hashlib.md5(path.encode()).hexdigest()}"
    spark.sql(f"create table if not exists {name} ({KIND}) using parquet clustered by (can) sorted by (can) into {int(buckets)} buckets location '{path.replace(chr(39), chr(92) + chr(39))}'")
    return name


def write_index(games: DataFrame, to: str, buckets: int = BUCKETS) -> None:
    """The signatures of games (with size, moves and movect), which must not be there yet. The
    number of buckets belongs to the index: it is asked for again when it is read."""
    plain = [F.col(c) for c in COLUMNS[3:]]
    rows = games.where("parse_error is null").select(*[c.alias(k) for k, c in signed(F.col("moves"), F.col("size")).items()], *plain).select(*COLUMNS)
    name = f"kifulake_{hashlib.md5(to.encode()).hexdigest()}"
    # a task holds whole buckets, so each bucket is one file
    rows.repartition(buckets, "can").write.mode("errorifexists").options(**BLOOM).option("path", to).bucketBy(buckets, "can").sortBy("can").format("parquet").saveAsTable(name)


def read_index(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    return spark.table(_table(spark, path, buckets))


def repeated(index: DataFrame) -> DataFrame:
    """can, n, first: signatures that several games have, and the first of those games. Buckets are grouped where they lie."""
    return index.groupBy("can").agg(F.count("*").alias("n"), F.min("game_id").alias("first")).where("n > 1")
