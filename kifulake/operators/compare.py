"""Comparing two games by their moves, and merging them.

Pairs come as a DataFrame with two move arrays; a pair is one row, so nothing shuffles
but the join that made the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.points import FIXED, mirrored, transformed


def _mv(moves: Column, t: int = 0) -> Column:
    return F.transform(moves, lambda m: transformed(m, t))


def differences(a: Column, b: Column) -> Column:
    """Array of (k, m1, m2) where the moves differ; '--' where one game has none left."""
    longest = F.greatest(F.size(a), F.size(b))
    ks = F.when(longest > 0, F.sequence(F.lit(1), longest)).otherwise(F.array().cast("array<int>"))
    each = F.transform(ks, lambda k: F.struct(k.alias("k"), F.coalesce(F.get(a, k - 1)["mv"], F.lit("--")).alias("m1"), F.coalesce(F.get(b, k - 1)["mv"], F.lit("--")).alias("m2")))
    return F.filter(each, lambda d: d["m1"] != d["m2"])


def common_prefix(a: Column, b: Column, t: int = 0) -> Column:
    """Moves that are equal before the first that differs; a under symmetry t."""
    n = F.least(F.size(a), F.size(b))
    ks = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    unequal = F.filter(ks, lambda k: transformed(F.get(a, k), t) != F.get(b, k)["mv"])
    return F.coalesce(F.array_min(unequal), n)


def histogram_distance(a: Column, b: Column, t: int = 0) -> Column:
    """Sum over all points of how far the counts are apart; a under symmetry t.

    Sorted letters are compared by counts of each distinct point of either game.
    """
    x, y = _mv(a, t), _mv(b)
    points = F.array_union(x, y)
    count = lambda side, p: F.size(F.filter(side, lambda q: q == p))
    return F.aggregate(points, F.lit(0), lambda acc, p: acc + F.abs(count(x, p) - count(y, p)))


def point_counts(games: DataFrame, key: str = "game_id") -> DataFrame:
    """(key, mv, n): the histogram as rows, for distances by join."""
    return games.select(key, F.explode(F.transform("moves", lambda m: m["mv"])).alias("mv")).groupBy(key, "mv").agg(F.count("*").alias("n"))


def best_symmetry(pairs: DataFrame, most: int = 12, key: str = "pair") -> DataFrame:
    """(key, t, distance, verdict, t_cut, distance_cut) of the symmetry of game a that brings it nearest to b.

    Untransformed wins unless another is strictly nearer; a symmetry counts only up to a
    distance of twice ``most``. Beyond that, games of different lengths are tried again as
    cut to the shorter one (t_cut, distance_cut; null where not tried): 'truncated' if that
    is near enough. Else the games are 'different'. All eight distances come from the pair's
    own row, so nothing is unnested or shuffled; pairs without one of the games give no row.
    """
    a, b = F.col("a"), F.col("b")
    best = pairs.where(a.isNotNull() & b.isNotNull()).withColumn("best", nearest(a, b))
    far = (F.col("best.t") > 0) & (F.col("best.distance") > 2 * most) & (F.size("a") != F.size("b"))
    short = lambda side: F.when(far, F.slice(side, 1, F.least(F.size("a"), F.size("b"))))
    both = best.withColumn("cut", nearest(short(a), short(b), most=2 * most)).select(key, "best.*", F.col("cut.t").alias("t_cut"), F.col("cut.distance").alias("distance_cut"))
    said = (
        F.when(F.col("t") == 0, "same orientation")
        .when(F.col("distance") <= 2 * most, "transformed")
        .when(F.col("distance_cut") <= 2 * most, "truncated")
        .otherwise("different")
    )
    return both.select(key, "t", "distance", said.alias("verdict"), "t_cut", "distance_cut")


#: Moves, and counts of points, that are looked at at once.
BLOCK = 1 << 20


def nearest(a: Column, b: Column, most: int = -1) -> Column:
    """(t, distance), the least distance; untransformed if its distance is within ``most``; null if either game is."""

    @F.arrow_udf("struct<t:int,distance:bigint>")
    def udf(x: pa.Array, y: pa.Array, mv: pa.Array, other: pa.Array) -> pa.Array:
        found = np.zeros((len(mv), 8), "i8")
        ends, at = np.cumsum(_sizes(mv) + _sizes(other)), 0
        while at < len(mv):
            to = max(at + 1, int(ends.searchsorted(BLOCK + (ends[at - 1] if at else 0), "right")))
            found[at:to] = distances(*[side.slice(at, to - at) for side in (x, y, mv, other)])
            at = to
        t = np.where(found[:, 0] <= most, 0, found.argmin(1))  # the first of the least
        none = pc.or_(mv.is_null(), other.is_null())
        return pa.StructArray.from_arrays([pa.array(t, pa.int32()), pa.array(found[np.arange(len(t)), t], pa.int64())], ["t", "distance"], mask=none)

    return udf(a["x"], a["y"], a["mv"], b["mv"])


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype("i8")


def distances(x: pa.Array, y: pa.Array, mv: pa.Array, other: pa.Array) -> np.ndarray:
    """A row for each pair, a column for each symmetry: how far the counts of all points are
    apart. x, y and mv are lists of the first games' moves, other of the second's."""
    numbers: dict = {}
    number = lambda name: numbers.setdefault(name, len(numbers))

    def numbered(names: pa.Array) -> np.ndarray:
        found = names.dictionary_encode("encode")
        return np.array([number(n) for n in found.dictionary.to_pylist()], "i8")[found.indices.to_numpy()]

    def turned(t: int, px: int, py: int) -> int:
        return number("".join(chr((z + 97) % 256) for z in mirrored(t, px, py, 18) if z >= -97))

    ours, theirs = numbered(mv.flatten()), numbered(other.flatten())
    points = pc.invert(pc.or_(x.flatten().is_null(), pc.is_in(mv.flatten(), pa.array(FIXED)))).to_numpy(zero_copy_only=False)
    px, py = (pc.fill_null(side.flatten(), 0).to_numpy(zero_copy_only=False).astype("i8")[points] for side in (x, y))
    each, which = np.unique(px << 32 | py, return_inverse=True)
    names = np.array([[turned(t, p >> 32, p & 0xFFFFFFFF) for t in range(8)] for p in each.tolist()], "i8").reshape(-1, 8)
    a_ends, b_ends = ([0, *np.cumsum(_sizes(side)).tolist()] for side in (mv, other))
    a_row, b_row = (np.repeat(np.arange(len(mv)), _sizes(side)) * len(numbers) for side in (mv, other))
    out, step = np.zeros((len(mv), 8), "i8"), max(1, BLOCK // max(1, len(numbers)))
    for t in range(8) if numbers else ():
        ours[points] = names[which, t]
        a_cells, b_cells = a_row + ours, b_row + theirs
        for at in range(0, len(mv), step):
            to = min(at + step, len(mv))
            count = lambda cells, ends: np.bincount(cells[ends[at] : ends[to]] - at * len(numbers), minlength=(to - at) * len(numbers))  # noqa: B023, E731
            out[at:to, t] = np.abs(count(a_cells, a_ends) - count(b_cells, b_ends)).reshape(to - at, -1).sum(1)
    return out


def alternating(moves: Column) -> Column:
    """Whether no color moves twice in a row, whichever begins."""
    return ~F.exists(F.transform(moves, lambda m, i: (i > 0) & (F.get(moves, i - 1)["color"] == m["color"])), lambda x: x)


#: More chunks than these are 'many differences'.
MOST_CHUNKS = 20


def verdict(a: Column, b: Column, most: int = 12) -> Column:
    """One phrase for a pair of games in the same orientation."""
    n = F.size(differences(a, b))
    prefix, short = common_prefix(a, b), F.least(F.size(a), F.size(b))
    same_length = F.size(a) == F.size(b)
    return (
        F.when((n == 0), "identical")
        .when((prefix == short) & ~same_length, "truncation")
        .when(same_length & (n <= most), "differences")
        .when(n - F.abs(F.size(a) - F.size(b)) <= most, "truncation and differences")
        .when(~alternating(a) | ~alternating(b), "non-alternating")
        .when(F.size(chunk_array(a, b)) <= MOST_CHUNKS, "chunks")
        .otherwise("many differences")
    )


def compared(pairs: DataFrame, most: int = 12, key: str = "pair") -> DataFrame:
    """(key, t, verdict): game a turned as best_symmetry says, then one phrase; games that no
    symmetry brings near are 'common start' (ten equal moves or more) or 'different games'."""
    s = best_symmetry(pairs, most, key).select(key, F.when(F.col("verdict") == "truncated", F.col("t_cut")).when(F.col("verdict") == "different", 0).otherwise(F.col("t")).alias("t"), (F.col("verdict") == "different").alias("far"))

    def turn(t: int) -> Column:
        def one(m):
            x, y = mirrored(t, m["x"], m["y"], F.lit(18))
            return m.withField("mv", transformed(m, t)).withField("x", x.cast("int")).withField("y", y.cast("int"))

        return F.transform("a", one)

    turned = F.coalesce(*[F.when(F.col("t") == t, turn(t)) for t in range(8)])
    both = pairs.join(s, key, "left").withColumn("t", F.coalesce("t", F.lit(0))).withColumn("turned", turned)
    away = F.when(common_prefix(F.col("a"), F.col("b")) >= 10, "common start").otherwise("different games")
    return both.select(key, "t", F.when(F.coalesce("far", F.lit(False)), away).otherwise(verdict(F.col("turned"), F.col("b"), most)).alias("verdict"))


def chunks_of(a: list[str], b: list[str]) -> list[dict]:
    """Two games as chunks: type 1 (only in a), 2 (only in b), 3 (in both), k1 and k2 (from 1;
    null where the chunk isn't in that game), length.

    A common chunk grows from a move that occurs once in each game, both ways, as long as the
    neighbouring moves are equal; it doesn't reach back into the chunk before. Those of the
    first game come in its order, then what is in the second alone.
    """
    at, twice = [{}, {}], [set(), set()]
    for side, game in enumerate((a, b)):
        for k, m in enumerate(game):
            (twice[side].add if m in at[side] else lambda _: None)(m)
            at[side][m] = k
    out, i = [], 0
    add = lambda kind, k1, k2, n: out.append({"type": kind, "k1": None if k1 is None else k1 + 1, "k2": None if k2 is None else k2 + 1, "length": n})
    covered = [False] * len(b)
    while i < len(a):
        end = next((k for k in range(i, len(a)) if a[k] in at[1] and a[k] not in twice[0] and a[k] not in twice[1]), None)
        if end is None:
            add(1, i, None, len(a) - i)
            break
        to = at[1][a[end]]
        k1, k2 = end, to
        while k1 > i and k2 > 0 and a[k1 - 1] == b[k2 - 1]:
            k1, k2 = k1 - 1, k2 - 1
        while end + 1 < len(a) and to + 1 < len(b) and a[end + 1] == b[to + 1]:
            end, to = end + 1, to + 1
        if i < k1:
            add(1, i, None, k1 - i)
        add(3, k1, k2, end - k1 + 1)
        covered[k2 : to + 1] = [True] * (to + 1 - k2)
        i = end + 1
    start = None
    for k in range(len(b) + 1):
        if k < len(b) and not covered[k]:
            start = k if start is None else start
        elif start is not None:
            add(2, None, start, k - start)
            start = None
    return out


CHUNKS = pa.list_(pa.struct([("type", pa.int32()), ("k1", pa.int32()), ("k2", pa.int32()), ("length", pa.int32())]))


def chunk_array(a: Column, b: Column) -> Column:
    """chunks_of two move arrays; moves without a point are all passes, colors don't count."""
    names = lambda moves: F.transform(moves, lambda m: F.when(m["x"].isNull(), "tt").otherwise(m["mv"]))

    @F.arrow_udf("array<struct<type:int,k1:int,k2:int,length:int>>")
    def udf(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else chunks_of(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], CHUNKS)

    return udf(names(a), names(b))


def chunks(pairs: DataFrame, a: str = "a", b: str = "b", key: str = "pair") -> DataFrame:
    """A row for each chunk of a pair: key, type, k1, k2, length."""
    return pairs.select(key, F.inline(chunk_array(F.col(a), F.col(b))))


def merged_moves(a: Column, b: Column, most: int = 0) -> Column:
    """(moves, notes): the first game's moves, the longer one's tail, and up to ``most``
    differing moves noted; null where more differ."""
    short = F.least(F.size(a), F.size(b))
    diffs = F.filter(differences(a, b), lambda d: d["k"] <= short)
    notes = F.transform(diffs, lambda d: F.concat(F.lit("move "), d["k"].cast("string"), F.lit(": "), d["m1"], F.lit(" / "), d["m2"]))
    longer = F.when(F.size(b) > F.size(a), F.concat(a, F.slice(b, F.size(a) + 1, F.greatest(F.size(b) - F.size(a), F.lit(1))))).otherwise(a)
    return F.when(F.size(diffs) <= most, F.struct(longer.alias("moves"), notes.alias("notes")))


def joined_notes(notes: Column) -> Column:
    """An array of notes as one comment, as merging several records' comments gives it."""
    return F.array_join(F.filter(notes, lambda n: n != ""), ".\n")


def merged_properties(a: Column, b: Column) -> Column:
    """Two property lists in a row without exact repeats; a result that begins another gives way to it."""
    both = F.array_distinct(F.concat(a, b))
    subsumed = lambda p: (p["id"] == "RE") & F.exists(both, lambda q: (q["id"] == "RE") & (q["vals"] != p["vals"]) & F.startswith(F.get(q["vals"], F.lit(0)), F.get(p["vals"], F.lit(0))))
    return F.filter(both, lambda p: ~F.coalesce(subsumed(p), F.lit(False)))
