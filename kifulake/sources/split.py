"""Cutting collections into the text of their games, by brackets alone: small files whole,
large ones in many tasks.

A game goes from ``(;`` to the bracket that closes it; brackets inside values don't count.
What stands between games is theirs who come after it (``lead``), and no byte is lost: leads
and games, one after the other, are the file.

A large file is read by Spark's own text source, split at closing brackets, so its parts are
read by many tasks from any store. Where a part begins no one knows how deep in a game, or
in a value, it is. Each part guesses where its first game starts: at the first start behind
the place where its brackets are lowest. What stands before that (its head) and the game
that it doesn't end (its tail) go to the part before and after it; the guess was right if
they make whole games there, which is checked for every part of every file. A file where
some part was wrong is read in order instead, a game at a time.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START = re.compile(rb"\(\s*;|\(\s*(?=T[A-Z]?\[)")
#: To the next bracket that counts: other text, and values with the brackets inside them.
SKIP = re.compile(rb"(?:[^()\[]++|\[[^\]\\]*+(?:(?:\\.|\](?!\s*+(?:[;()\[A-Za-z]|\Z)))[^\]\\]*+)*+\])*+", re.S)
#: A bracket that ends a value.
CLOSING = re.compile(rb"\](?=\s*(?:[;()\[A-Za-z]|\Z))")
GAME = "game_nr int, run boolean, lead binary, text binary"
#: Bytes above which a file is read in parts; bytes in which a part looks for its lowest brackets.
LARGE, WINDOW = 32 << 20, 8 << 20


class Cutter:
    """Takes bytes in order, gives (lead, text) of each game that is complete."""

    def __init__(self):
        self.data, self.from_, self.begin, self.at, self.depth = bytearray(), 0, -1, 0, 0

    def feed(self, more: bytes) -> Iterator[tuple[bytes, bytes]]:
        """more must end behind a closing bracket, or be the last."""
        self.data += more
        data, size = self.data, len(self.data)
        while True:
            if self.begin < 0:
                m = START.search(data, self.at)
                if not m:
                    self.at = size  # a start doesn't go over a closing bracket
                    break
                self.begin = self.at = m.start()
                self.depth = 0
            at = SKIP.match(data, self.at).end()
            if at >= size or data[at] == 91:
                self.at = at
                break
            self.depth += 1 if data[at] == 40 else -1
            self.at = at + 1
            if self.depth == 0:
                yield bytes(data[self.from_ : self.begin]), bytes(data[self.begin : self.at])
                self.from_, self.begin = self.at, -1
        if self.from_ > 1 << 20:
            del data[: self.from_]
            self.at, self.begin, self.from_ = self.at - self.from_, self.begin - self.from_ if self.begin >= 0 else -1, 0

    def rest(self) -> tuple[bytes, bytes]:
        """What is left: text that belongs to no game, and the game that wasn't closed."""
        end = self.begin if self.begin >= 0 else len(self.data)
        return bytes(self.data[self.from_ : end]), bytes(self.data[end:])


def cut(data: bytes) -> list[tuple[int, bool, bytes, bytes]]:
    """(game_nr, run, lead, text) of a whole file's games; the last may be unfinished. run:
    only white space stands between the games so far. Text behind the last game is an entry of
    its own, number 0, without a game."""
    own, out, run = Cutter(), [], True
    found = list(own.feed(data))
    lead, text = own.rest()
    for i, (a, b) in enumerate([*found, (lead, text)] if text else found, 1):
        run = run and (i == 1 or not a.strip())
        out.append((i, run, a, b))
    if not text and lead.strip():
        out.append((0, False, lead, b""))
    return out


def first_start(data: bytes) -> int:
    """Where, as it seems, the first game starts in text that begins anywhere behind a closing
    bracket: behind the place where the brackets are lowest for the first time. -1: nowhere."""
    at = depth = lowest = low = 0
    opening = data.find(b"[")
    if (m := CLOSING.search(data)) and (opening < 0 or m.start() < opening):
        at = low = m.end()  # it began inside a value
    while True:
        at = SKIP.match(data, at).end()
        if at >= len(data) or data[at] == 91:
            break
        depth += 1 if data[at] == 40 else -1
        at += 1
        if depth < lowest:
            lowest, low = depth, at
    m = START.search(data, low)
    return m.start() if m else -1


def cut_column(content: Column) -> Column:
    """A file's content as an array of GAME."""
    kind = pa.list_(pa.struct([("game_nr", pa.int32()), ("run", pa.bool_()), ("lead", pa.binary()), ("text", pa.binary())]))

    @F.arrow_udf(f"array<struct<{', '.join(x.replace(' ', ':') for x in GAME.split(', '))}>>")
    def udf(a: pa.Array) -> pa.Array:
        return pa.array([cut(x or b"") for x in a.to_pylist()], kind)

    return udf(content)


def _fragments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The files between closing brackets, each with the part it is read in."""
    lines = spark.read.option("lineSep", ")").text(paths)
    at = lines.metadataColumn("_metadata")
    return lines.select(at["file_path"].alias("path"), at["file_block_start"].alias("part"), (at["file_block_start"] + at["file_block_length"] >= at["file_size"]).alias("last"), at["file_size"].alias("size"), F.col("value").cast("binary").alias("value"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """((path, part, last, size), its bytes in pieces of about WINDOW), part by part."""

    def rows():
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("path", "part", "last", "size")), strict=True))
            begin = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[begin]:
                    yield keys[begin], b")".join([*b.column("value").slice(begin, i - begin).to_pylist(), b""])
                    begin = i

    pending = None
    every = rows()

    def own(key, first):
        nonlocal pending
        held = [first]
        for k, data in every:
            if k != key:
                pending = (k, data)
                break
            if sum(map(len, held)) >= WINDOW:
                yield b"".join(held)
                held = []
            held.append(data)
        yield b"".join(held)

    for found in every:
        pending = found
        while pending:
            (key, data), pending = pending, None
            yield key, own(key, data)


def _cut_parts(edges: bool):
    """Games that a part holds whole (edges False), or its head, its tail and their numbers."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, part, last, size), pieces in _parts(batches):
            cutter, head, total, n, held, started = Cutter(), b"", 0, 0, None, False
            rows: list = []
            broken = None
            for piece in pieces:
                total += len(piece)
                if not started:
                    piece = head + piece if part else piece
                    start = first_start(piece) if part else 0
                    if start < 0:
                        head = piece
                        continue
                    head, piece, started = piece[:start], piece[start:], True
                for game in cutter.feed(piece):
                    if held is not None:
                        n += 1
                        broken = n if broken is None and held[0].strip() and (part or n > 1) else broken
                        if not edges:
                            rows.append((path, part, 0, n, *held))
                    held = game
                    if len(rows) >= 256:
                        yield _batch(rows)
                        rows = []
            tail = b"".join(cutter.rest())
            if held is not None and last:  # its end may be a bracket that the file doesn't have
                tail = held[0] + held[1] + tail
            elif held is not None:
                n += 1
                broken = n if broken is None and held[0].strip() and (part or n > 1) else broken
                rows.append((path, part, 0, n, *held))
            if not edges:
                yield _batch(rows)
                continue
            kinds = [("path", pa.string()), ("part", pa.int64()), ("started", pa.bool_()), ("last", pa.bool_()), ("missing", pa.int64()), ("n", pa.int64()), ("broken", pa.int64()), ("head", pa.binary()), ("tail", pa.binary())]
            values = (path, part, started, last, total - (size if last else 0), n, broken, head, tail if started else b"")
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, kinds, strict=True)], [k for k, _ in kinds])

    return one


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["path", "part", "edge", "i", "lead", "text"])


CUT = "path string, part long, edge int, i long, lead binary, text binary"
EDGES = "path string, part long, started boolean, last boolean, missing long, n long, broken long, head binary, tail binary"


def _stitched(edges: DataFrame) -> DataFrame:
    """path, part, whole, games: what stands between the games of one part and those of the next.

    part: the one behind whose games they come, -1 before all; whole: all of it are games."""
    order = Window.partitionBy("path").orderBy("part")
    before = F.max(F.when(F.col("started"), F.col("part"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # the bytes of all parts are one more than the file has where it doesn't end with a bracket;
    # a byte order mark's three don't reach us
    spare = F.sum("missing").over(Window.partitionBy("path")).isin(1, -2)
    known = edges.withColumns({"before": F.coalesce(before, F.lit(-1)), "spare": spare})
    head = F.struct(F.col("before").alias("region"), (2 * F.col("part")).alias("at"), F.col("head").alias("data"), (F.col("last") & ~F.col("started")).alias("last"))
    tail = F.struct(F.when(F.col("started"), F.col("part")).alias("region"), (2 * F.col("part") + 1).alias("at"), F.col("tail").alias("data"), F.col("last").alias("last"))
    pieces = known.select("path", "spare", F.explode(F.array(head, tail)).alias("x")).select("path", "x.*", (F.col("spare") & F.col("x.last")).alias("spare")).where("region is not null")
    regions = pieces.groupBy("path", "region").agg(F.array_sort(F.collect_list(F.struct("at", "data"))).alias("parts"), F.max("spare").alias("spare"), F.max("last").alias("last"))
    kind = "struct<whole:boolean,games:array<struct<i:long,lead:binary,text:binary>>>"
    shape = pa.struct([("whole", pa.bool_()), ("games", pa.list_(pa.struct([("i", pa.int64()), ("lead", pa.binary()), ("text", pa.binary())])))])

    @F.arrow_udf(kind)
    def joined(parts: pa.Array, spare: pa.Array, last: pa.Array) -> pa.Array:
        out = []
        for ps, extra, end in zip(parts.to_pylist(), spare.to_pylist(), last.to_pylist(), strict=True):
            data = b"".join(p["data"] for p in ps)
            cutter = Cutter()
            found = list(cutter.feed(data[:-1] if extra else data))
            lead, text = cutter.rest()
            if end and (text or lead.strip()):
                found.append((lead, text))
            out.append({"whole": end or not text, "games": [{"i": i, "lead": a, "text": b} for i, (a, b) in enumerate(found, 1)]})
        return pa.array(out, shape)

    return regions.withColumn("x", joined("parts", "spare", "last")).select("path", F.col("region").alias("part"), "x.whole", "x.games")


def _in_order(fragments: DataFrame) -> DataFrame:
    """Each file's games from its start on, the file's parts in one task, a game at a time."""

    def numbered(batches):
        seen: dict = {}
        for b in batches:
            keys = list(zip(b.column("path").to_pylist(), b.column("part").to_pylist(), strict=True))
            place = [seen.__setitem__(k, seen.get(k, 0) + 1) or seen[k] for k in keys]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int64())], [*b.schema.names, "i"])

    def streamed(batches):
        path, cutter, n, held, total, size = None, Cutter(), 0, b"", 0, 0

        def ended():
            # the last piece's bracket isn't in a file that doesn't end with one
            rows = [(path, 0, 0, n + i, *game) for i, game in enumerate(cutter.feed(held[:-1] if total - size in (1, -2) else held), 1)]
            lead, text = cutter.rest()
            return rows + [(path, 0, 0, n + len(rows) + 1, lead, text)] if text or lead.strip() else rows

        for b in batches:
            rows = []
            for row in b.select(["path", "size", "value"]).to_pylist():
                if row["path"] != path:
                    rows += ended() if path is not None else []
                    path, cutter, n, held, total, size = row["path"], Cutter(), 0, b"", 0, row["size"]
                for game in cutter.feed(held):
                    n += 1
                    rows.append((path, 0, 0, n, *game))
                held = row["value"] + b")"
                total += len(held)
            yield _batch(rows)
        if path is not None:
            yield _batch(ended())

    kind = "path string, part long, last boolean, size long, value binary, i long"
    rows = fragments.mapInArrow(numbered, kind).repartition("path").sortWithinPartitions("path", "part", "i")
    return rows.mapInArrow(streamed, CUT)


def large_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, n_games and GAME of files that are read in parts. The parts' heads and tails are
    saved (a game or two a part); games are read when they are asked for."""
    fragments = _fragments(spark, paths)
    edges = checkpointed(fragments.mapInArrow(_cut_parts(True), EDGES))
    stitched = checkpointed(_stitched(edges))
    unsure = stitched.where("not whole").select("path").distinct()
    between = stitched.select("path", "part", F.lit(1).alias("edge"), F.explode("games").alias("g")).select("path", "part", "edge", "g.*")
    games = fragments.mapInArrow(_cut_parts(False), CUT).unionByName(between)
    inner = F.filter("games", lambda g: (g["i"] > 1) | (F.col("part") >= 0))
    first = F.array_min(F.transform(F.filter(inner, lambda g: F.length(F.btrim(g["lead"].cast("string"), F.lit(" \t\r\n\x0b\x0c"))) > 0), lambda g: g["i"]))
    counts = edges.select("path", "part", F.lit(0).alias("edge"), "n", "broken").unionByName(stitched.select("path", "part", F.lit(1).alias("edge"), F.size(F.filter("games", lambda g: F.length(g["text"]) > 0)).cast("long").alias("n"), first.alias("broken")))
    if wrong := unsure.limit(1).count():
        games = games.join(unsure, "path", "left_anti")
        counts = counts.join(unsure, "path", "left_anti")
    each = Window.partitionBy("path")
    placed = counts.withColumn("offset", F.sum("n").over(each.orderBy("part", "edge").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    placed = placed.withColumns({"n_games": F.sum("n").over(each), "stop": F.min(F.col("offset") + F.col("broken")).over(each)}).select("path", "part", "edge", "offset", "n_games", "stop")
    numbered = games.join(placed, ["path", "part", "edge"]).withColumn("nr", F.col("offset") + F.col("i"))
    if wrong:
        ordered = checkpointed(_in_order(_fragments(spark, [r.path for r in unsure.collect()])))
        blank = F.length(F.btrim(F.col("lead").cast("string"), F.lit(" \t\r\n\x0b\x0c"))) == 0
        told = ordered.groupBy("path").agg(F.count_if(F.length("text") > 0).alias("n_games"), F.min(F.when(~blank & (F.col("i") > 1), F.col("i"))).alias("stop"))
        again = ordered.join(told, "path").withColumn("nr", F.col("i"))
        numbered = numbered.select("path", "n_games", "nr", "stop", "lead", "text").unionByName(again.select("path", "n_games", "nr", "stop", "lead", "text"))
    bare = F.length("text") == 0  # text behind the last game
    run = ~bare & F.coalesce(F.col("nr") < F.col("stop"), F.lit(True))
    return numbered.select("path", (F.col("n_games")).cast("int").alias("n_games"), F.when(bare, 0).otherwise(F.col("nr")).cast("int").alias("game_nr"), run.alias("run"), "lead", "text")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a session on one machine that has none gets one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or f"/tmp/kifulake-{uuid.uuid4().hex}")
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """A copy in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def texts(spark: SparkSession, paths: str | list[str], recursive: bool = False, extension: str = ".sgf", large: int = LARGE) -> DataFrame:
    """path, n_games and GAME: a row for each game of each file, and one for text behind the
    last. Files of more than ``large`` bytes are read in parts; no row depends on it."""
    from .sgf import scan

    files = scan(spark, paths, recursive, extension)
    found = files.where(F.col("length") <= large).select("path", cut_column(F.col("content")).alias("games"))
    # explode_outer: a plain explode would make Catalyst infer a filter on the UDF, and cut twice
    whole = found.select("path", F.size(F.filter("games", lambda g: g["game_nr"] > 0)).alias("n_games"), F.explode_outer("games").alias("g")).where("g is not null").select("path", "n_games", "g.*")
    # names alone, of large files alone: Spark's own listing holds as many on the driver
    many = [r.path for r in files.where(F.col("length") > large).select("path").collect()]
    return whole.unionByName(large_texts(spark, many)) if many else whole
