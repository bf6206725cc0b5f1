"""Chunks by rows against the walk over two games; ranges and reports of differences."""

import random

import pytest
from pyspark.sql import functions as F

from kifulake.operators import chunks, compare
from kifulake.sources import sgf


def game(names):
    return [{"color": "BW"[i % 2], "x": None if m == "tt" else ord(m[0]) - 97, "y": None if m == "tt" else ord(m[1]) - 97, "mv": m} for i, m in enumerate(names)]


def test_chunks_are_those_of_the_walk(spark):
    rng = random.Random(12)
    points = [a + b for a in "abcde" for b in "abcde"] + ["tt"]
    pairs = [([], []), (["aa"], []), ([], ["aa", "bb"]), (["aa", "bb"], ["aa", "bb"]), (["aa", "aa"], ["aa"]), (["tt", "aa", "tt"], ["tt", "tt", "aa"])]
    for _ in range(150):
        a = [rng.choice(points) for _ in range(rng.randrange(1, 25))]
        i, j = sorted(rng.sample(range(len(a) + 1), 2))
        b = rng.choice([a[i:] + a[:i], a[:i] + [rng.choice(points)] + a[i:], a[:i] + a[j:] + a[i:j], a[j:] + a[i:j] + a[:i], [rng.choice(points) for _ in a]])
        pairs.append((a, b))
    df = spark.createDataFrame([(i, game(a), game(b)) for i, (a, b) in enumerate(pairs)], f"pair int, a array<{sgf.MOVE}>, b array<{sgf.MOVE}>")
    got: dict = {}
    for r in chunks.chunks(df).collect():
        got.setdefault(r.pair, []).append((r.type, r.k1, r.k2, r.length))
    for i, (a, b) in enumerate(pairs):
        want = [(c["type"], c["k1"], c["k2"], c["length"]) for c in compare.chunks_of(a, b)]
        assert sorted(got.get(i, []), key=str) == sorted(want, key=str), (a, b)


@pytest.mark.parametrize(("ks", "want"), [([], ""), ([3], "3"), ([3, 5, 6, 7, 9], "3, 5-7, 9"), ([1, 2], "1-2")])
def test_ranges(spark, ks, want):
    df = spark.createDataFrame([(ks,)], "k array<int>")
    assert df.select(chunks.ranges(F.col("k")).alias("r")).first().r == want


def test_reports(spark):
    df = spark.createDataFrame([(game(["aa", "ql", "cc", "dd"]), game(["aa", "rl", "cd"]))], f"a array<{sgf.MOVE}>, b array<{sgf.MOVE}>")
    d = compare.differences(F.col("a"), F.col("b"))
    row = df.select(chunks.report(d).alias("x"), chunks.report(d, 1, named=True).alias("y"), chunks.ranges(F.transform(d, lambda x: x["k"])).alias("z")).first()
    assert tuple(row) == ("2: ql rl\n3: cc cd\n4: dd --", "2: R8 S8\n2 more", "2-4")
