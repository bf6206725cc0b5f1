"""Records as they arrive: a folder watched by Structured Streaming, parsed and signed on
the way into a table. The file source keeps track of what it has seen in the checkpoint,
so each file is read once. Copies of a record in other files, turned or mirrored ones too,
have its signature: state keyed by that keeps the first, for as long as the watermark says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import signatures
from ..sources import sgf

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream(spark: SparkSession, folder: str, extension: str = ".sgf", per_trigger: int = 1000, **options) -> DataFrame:
    """A streaming DataFrame of games."""
    return sgf.games(watched(spark, folder, extension, per_trigger), **options)


def first_seen(files: DataFrame, within: str = "1 day", turned: bool = True, **options) -> DataFrame:
    """Signed games of a stream of files, each signature once: of games whose files' times lie
    within so long of each other, the first that arrives. turned: a game under a symmetry is
    the same one. Signatures older than the watermark leave the state, so it is bounded by
    the games of that time; games that can't be parsed are all kept out."""
    late = files.withWatermark("modificationTime", within)
    every = late.select("path", "modificationTime", sgf.parsed(F.col("content"), **options).alias("games"))
    rows = every.select("path", "modificationTime", F.explode("games").alias("g")).select("path", "modificationTime", "g.*").where("parse_error is null")
    game_id = F.concat_ws("#", "path", F.col("game_nr").cast("string"))
    last = F.col("size") - 1
    canx = signatures.canonical(F.col("moves"), True, last)
    found = rows.select("modificationTime", game_id.alias("game_id"), "path", "game_nr", "size", (F.size("moves") - F.col("setup")).alias("movect"), signatures.md5(F.col("moves")).alias("md5"), F.substring(canx, 1, 32).alias("can"), canx.alias("canx"), "moves")
    return found.dropDuplicatesWithinWatermark(["size", "can" if turned else "md5"])


def watched(spark: SparkSession, folder: str, extension: str = ".sgf", per_trigger: int = 1000) -> DataFrame:
    """A streaming DataFrame of files."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_trigger)
    return (reader.option("pathGlobFilter", f"*{extension}") if extension else reader).load(folder)


def ingest_once(spark: SparkSession, folder: str, to: str, checkpoint: str, within: str = "1 day", turned: bool = True, per_trigger: int = 1000, **options) -> StreamingQuery:
    """As ingest, each signature once; a query that is started again knows those of before."""
    found = first_seen(watched(spark, folder, per_trigger=per_trigger), within, turned, **options)
    return found.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def signed(games: DataFrame) -> DataFrame:
    last = F.col("size") - 1
    return games.select("game_id", "path", "game_nr", "size", (F.size("moves") - F.col("setup")).alias("movect"), signatures.md5(F.col("moves")).alias("md5"), signatures.canonical(F.col("moves"), True, last).alias("canx"), "moves", "parse_error")


def ingest(spark: SparkSession, folder: str, to: str, checkpoint: str, **options) -> StreamingQuery:
    """Starts the query; what is there already is taken at once."""
    return signed(stream(spark, folder, **options)).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
