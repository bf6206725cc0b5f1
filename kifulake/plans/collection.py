"""A collection of games as a fluent query: from files or from the database.

Predicates and projections are named as the command-line tools name theirs; they build
one DataFrame plan, in which Catalyst prunes what isn't asked for (the parse's unused
fields, the replay) and pushes what can be decided by path into the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.points import symmetry
from ..functions.predicates import Interval, string_test
from ..operators import bitmap, board, moves, pattern, properties, signatures
from ..sources import index, sgf, split, writer

#: Projections that the database holds as columns, which Parquet's statistics can prune by.
STORED = {"m": "movect", "Bcapt": "black_captured", "Wcapt": "white_captured", "md5": "md5", "can": "can", "canx": "canx"}
#: What no longer holds of a game whose moves are cut or turned.
OF_MOVES = ("md5", "can", "canx", "black", "white")
#: Rows of a reference that a join may broadcast; their number is checked.
BROADCAST = 300_000
PROPERTIES = ("prop", "rprop", "nrprop", "mprop", "mrprop")


@dataclass(frozen=True)
class Collection:
    """games: a row for each game. stored: the rows come from the database, without properties.
    texts: they have the game's text, from which properties are read one by one (full_ids:
    with the lower-case letters of their names)."""

    games: DataFrame
    stored: bool = False
    texts: bool = False
    full_ids: bool = False

    @classmethod
    def of_files(cls, spark: SparkSession, paths, recursive: bool = False, extension: str = ".sgf", strict: bool = False, full_ids: bool = False, many: bool = False, second_node: bool = False, large: int = split.LARGE) -> Collection:
        """strict: files are parsed whole, and issues are found. large: bytes above which a file
        is read in parts, by many tasks."""
        if strict:
            return cls(sgf.games(sgf.scan(spark, paths, recursive, extension), strict=True, full_ids=full_ids, many=many, second_node=second_node))
        found = split.texts(spark, paths, recursive, extension, large)
        found = found.where((F.col("run") & (F.col("game_nr") > 0)) | (F.col("n_games") == 0) if not many else (F.col("game_nr") > 0) | (F.col("n_games") == 0))
        return cls(sgf.typed(found, full_ids, second_node), texts=True, full_ids=full_ids)

    @classmethod
    def of_database(cls, spark: SparkSession, path: str) -> Collection:
        return cls(writer.read_database(spark, path), True)

    @classmethod
    def of_index(cls, spark: SparkSession, path: str, buckets: int = index.BUCKETS) -> Collection:
        """Signatures alone (md5, can, canx), with m, x and fn."""
        return cls(index.read_index(spark, path, buckets), True)

    # ---- columns

    def value(self, name: str) -> Column:
        """A projection by name: x, fn, sz, h, m, N, player, winner, loser, md5, can, canx,
        DsA, DsB, DsC, DnA, s, Bcapt, Wcapt, capt, P, P<move>, k (after where_pattern), propXY,
        rpropXY, nrpropXY, mpropXY, prop, rprop, nrprop, mprop, M<list>, and all moves as
        numbered lines: M, Mc, Mx, with I or A behind the M for initial stones or both. Of the
        database, m and the captures are columns of their own."""
        if self.stored and STORED.get(name) in self.games.columns:
            return F.col(STORED[name])
        m, setup = F.col("moves"), F.col("setup")
        simple: dict[str, Callable[[], Column]] = {
            "x": lambda: F.col("game_nr"),
            "fn": lambda: F.col("path"),
            "sz": lambda: F.col("size"),
            "h": lambda: properties.handicap(F.col("abct"), F.col("awct")),
            "m": lambda: F.col("movect") if "movect" in self.games.columns else F.size(m) - setup,
            "N": lambda: F.col("n_games"),
            "s": lambda: signatures.joined(m),
            "md5": lambda: signatures.md5(m),
            "can": lambda: signatures.canonical(m, last=F.col("size") - 1),
            "canx": lambda: signatures.canonical(m, True, F.col("size") - 1),
            "Bcapt": lambda: board.captured(self.events(), "B"),
            "Wcapt": lambda: board.captured(self.events(), "W"),
            "capt": lambda: board.captured(self.events()),
            "P": lambda: board.position_sgf(board.final_stones(self.events()), F.col("size")),
            "player": lambda: properties.players(self.value("rpropPB"), self.value("rpropPW")),
            "winner": lambda: properties.winner(*(self.value(f"rprop{p}") for p in ("RE", "PB", "PW"))),
            "loser": lambda: properties.loser(*(self.value(f"rprop{p}") for p in ("RE", "PB", "PW"))),
        }
        if name in simple:
            return simple[name]()
        if name[:2] == "Ds":
            return signatures.dyer(m, name[2:] if name[2:] in signatures.DYER else tuple(map(int, name[2:].split(","))))
        if name[:2] == "Dn":
            return signatures.dyer_normalised(m, name[2:] if name[2:] in signatures.DYER else tuple(map(int, name[2:].split(","))), F.col("size") - 1)
        if name == "k":
            if "k" not in self.games.columns:
                raise ValueError("k is there after where_pattern alone")
            return F.col("k")
        if re.fullmatch(r"P\d+", name):
            return board.position_sgf(board.final_stones(self.events(), int(name[1:])), F.col("size"))
        if found := re.fullmatch(r"M([IA]?)([cx]?)|M([cx])([IA])", name):
            return moves.every(m, setup, found[1] or found[4] or "", found[2] or found[3] or "")
        if name[:1] == "M":
            return F.array_join(moves.listed(m, name[1:] or None, setup=setup), " ")
        for prefix, where, kind in (("mrprop", "root", "all"), ("mprop", "all", "all"), ("nrprop", "rest", "first"), ("rprop", "root", "first"), ("prop", "all", "first"), ("--", "all", "first")):
            if name.startswith(prefix):
                if self.stored:
                    raise ValueError("the database holds no properties")
                nodes, of = F.col("nodes"), name[len(prefix) :]
                if self.texts and kind == "first" and of:
                    return sgf.first_value(F.col("text"), of, where, self.full_ids)
                if not of:
                    return properties.multi_ids(nodes, where) if kind == "all" else properties.ids(nodes, where)
                return properties.first_all(nodes, of, where) if kind == "all" else properties.first_value(nodes, of, where)
        raise ValueError(f"no such projection: {name!r}")

    def events(self) -> Column:
        return F.col("events") if self.stored else board.plays(F.col("size"), F.col("moves"), F.col("setup"))["events"]

    # ---- selection

    def where(self, name: str, op: str = "", value: str = "") -> Collection:
        """An interval for numbers (where('m', '100-')), else a string test (where('propDT', ':', '2003'))."""
        if op in ("=", ":", "!", "!=", "!:"):
            test = string_test(self.value(name), op, value)
            return replace(self, games=self.games.where(self.may_hold(name, op, value) & test if self.texts else test))
        return replace(self, games=self.games.where(Interval.parse(op).test(self.value(name))))

    def may_hold(self, name: str, op: str, value: str) -> Column:
        """Whether a game's text can pass a test, told by its bytes before anything is parsed:
        a property's value stands in the text as it is, but for white space behind brackets.
        Text that isn't UTF-8 may hold other bytes for what isn't ASCII."""
        if op not in ("=", ":") or not value or "]" in value or not re.match(r"(n?r)?prop[A-Z]|--|winner|loser", name):
            return F.lit(True)
        found = F.contains(F.col("text"), F.lit(value.encode()))
        return found if value.isascii() else found | ~F.is_valid_utf8(F.col("text").cast("string"))

    def where_played(self, text: str, color: str | None = None) -> Collection:
        wanted = moves.positions(text, color)
        if "black" in self.games.columns:
            bits, rest = moves.played_bits(F.col("black"), F.col("white"), wanted)
            return replace(self, games=self.games.where(bits & moves.played(F.col("moves"), rest, F.col("setup")) if rest else bits))
        return replace(self, games=self.games.where(moves.played(F.col("moves"), wanted, F.col("setup"))))

    def where_pattern(self, text: str, all_symmetries: bool = False, swap: bool = False) -> Collection:
        """Games with the pattern; the move of the first match comes as column k."""
        size, wanted = pattern.constraints(text)
        rows = pattern.variants(wanted, size - 1, all_symmetries, swap)
        # games that never had the stones of any variant aren't replayed, nor are their events unnested
        bits = (F.col(c) if c in self.games.columns else bitmap.point_words(F.col("moves"), k) for k, c in bitmap.COLUMNS.items())
        able = self.games.where((F.col("size") == size) & bitmap.may_match(*bits, rows))
        events = able.select("game_id", F.explode(self.events()).alias("e")).select("game_id", "e.*")
        found = pattern.first_match(events, rows)
        return replace(self, games=able.join(found.select("game_id", F.col("first_move").alias("k")), "game_id"))

    def like(self, reference: Collection, *names: str, every: bool = False) -> Collection:
        """Games whose projections equal those of the reference's one game; every: of any of its
        games, as many as there are. Few references are broadcast; where there are more, they
        are dealt to an index's buckets, and its games stay where they are."""
        ref = reference.games.select(*[reference.value(n).alias(f"_{i}") for i, n in enumerate(names)])
        ref = ref.distinct() if every else ref.limit(1)
        if not every or ref.limit(BROADCAST + 1).count() <= BROADCAST:
            ref = F.broadcast(ref)
        keys = [f"_{i}" for i in range(len(names))]
        same = [self.value(n) == ref[k] for n, k in zip(names, keys, strict=True)]
        return replace(self, games=self.games.join(ref, same, "left_semi"))

    def truncated(self, keep: int | None = None, drop: int | None = None) -> Collection:
        """Moves are cut, and what the database holds of their number follows; captures stay those of the whole game."""
        cut = moves.truncated(F.col("moves"), keep, drop, F.col("setup"))
        return replace(self, games=self.games.withColumns({"moves": cut, "movect": F.size(cut) - F.col("setup")}).drop(*OF_MOVES))

    def turned(self, t: int | str) -> Collection:
        """All moves under symmetry t, by number or name (points.symmetry)."""
        t = symmetry(t) if isinstance(t, str) else t
        return replace(self, games=self.games.withColumn("moves", moves.with_symmetry(F.col("moves"), t, F.col("size") - 1)).drop(*OF_MOVES))

    # ---- results

    def select(self, *names: str, one_line: bool = False) -> DataFrame:
        shape = (lambda c: properties.one_line(c.cast("string"))) if one_line else (lambda c: c)
        return self.games.select(*[shape(self.value(n)).alias(n) for n in names])

    def lines(self, *names: str) -> DataFrame:
        """One text for each game: values, then file name and game number."""
        number = F.when(F.coalesce(F.col("n_games"), F.lit(1)) > 1, F.concat(F.lit("# "), F.col("game_nr").cast("string"))) if "n_games" in self.games.columns else F.lit(None)
        return self.games.select(F.concat_ws("  ", *[self.value(n).cast("string") for n in names], F.col("path"), number).alias("value"))

    def count_per_file(self) -> DataFrame:
        return self.games.groupBy("path").agg(F.count("*").alias("N"))
