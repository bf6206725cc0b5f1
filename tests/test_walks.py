"""Running sums in place of replays and self joins: repeated positions, numbers of moves in trees."""

import collections
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from kifulake.operators import board, repeats, tree
from kifulake.plans import bridge
from kifulake.sources import sgf

SF = "/root/testdata/sf0.001"


def playout(rng, size=3, n=60):
    """A legal game on a small board, where positions do come again."""
    moves, points = [], [(x, y) for x in range(size) for y in range(size)]
    for k in range(n):
        color = "BW"[k % 2]
        rng.shuffle(points)
        for x, y in points:
            new = [*moves, {"color": color, "x": x, "y": y, "mv": chr(97 + x) + chr(97 + y)}]
            if board.replay(size, new, 0)["error"] is None:
                moves = new
                break
        else:
            moves.append({"color": color, "x": None, "y": None, "mv": "tt"})
    return moves


def test_repeats_are_those_of_the_replay(spark):
    rng = random.Random(2)
    games = [(i, 3, playout(rng), 0) for i in range(25)]
    setup = sgf.parse("(;SZ[3]AB[aa]AW[cc];B[bb];W[ab];B[ba])")[0]
    games.append((99, 3, setup["moves"], setup["setup"]))
    g = board.with_plays(spark.createDataFrame(games, f"game_id long, size int, moves array<{sgf.MOVE}>, setup int")).cache()
    want = {r.game_id: r.plays.cycle_move for r in g.collect() if r.plays.cycle_move is not None}
    got = {r.game_id: r.cycle_move for r in repeats.first_repeat(board.exploded_plays(g)).collect()}
    assert got == want and len(want) > 5


def test_no_repeat_without_events(spark):
    assert repeats.repeated(spark.createDataFrame([], "game_id long, ev int, move_nr int, color string, x int, y int, is_pass boolean")).collect() == []


def grown(rng, depth=0):
    nodes = "".join(rng.choice([";B[aa]", ";W[bb]", ";C[x]", ";"]) for _ in range(rng.randrange(1, 4)))
    return "(" + nodes + "".join(grown(rng, depth + 1) for _ in range(rng.choice([0, 0, 2, 3]) if depth < 5 else 0)) + ")"


def test_move_numbers_of_trees(spark, tmp_path):
    rng = random.Random(6)
    texts = ["(;B[aa]" + grown(rng) + grown(rng) + ")" for _ in range(12)] + ["(;C[x])", "(" + ";B[aa]" * 500 + "(;W[bb])" * 2000 + ")"]
    (tmp_path / "a.sgf").write_text("\n".join(texts))
    rows = sgf.nodes(sgf.games(sgf.scan(spark, str(tmp_path))))
    got = {(r.game_nr, r.node_id): r.nr for r in tree.move_numbers(rows).collect()}
    want = {}
    for nr, text in enumerate(texts, 1):
        (game,) = sgf.parse(text)
        for n in game["nodes"]:
            own = any(p["id"] in ("B", "W") for p in n["props"])
            want[nr, n["node_id"]] = own + (want[nr, n["parent"]] if n["parent"] >= 0 else 0)
    assert got == want and len(got) > 2500
    plan = tree.tree_rows(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    labels = [r.label for r in tree.tree_rows(rows).where("game_nr = 14").orderBy("run").collect()]
    assert labels[0] == "1-500" and labels[1:] == ["  501-501"] * 2000


@pytest.mark.parametrize("name", ["pos_played_bits", "pattern_bits", "repeated_positions", "ref_many_semi_join", "scan_in_parts", "merge_collections", "chunk_diff"])
def test_rows_are_those_of_the_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{SF}/events.parquet'")
    found = bridge.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = con.sql(bridge.ORACLE[name])
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = collections.Counter(tuple(r[c] for c in columns) for r in found.select(*[F.col(c) for c in columns]).collect())
    assert got == collections.Counter(tuple(r[i] for i in at) for r in want.fetchall())
