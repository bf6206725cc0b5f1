"""Records as they arrive: each signature once, across triggers and restarts, with bounded state."""

import os
import time

from kifulake.streaming import ingest

GAME, OTHER = "(;SZ[9];B[ab];W[cd];B[ee])", "(;SZ[9];B[aa];W[cc])"
#: GAME mirrored in the diagonal; on another board.
TURNED, WIDER = "(;SZ[9];B[ba];W[dc];B[ee])", "(;SZ[13];B[ab];W[cd];B[ee])"


def arrive(folder, name, text, at):
    (folder / name).write_text(text)
    os.utime(folder / name, (at, at))


def test_a_record_that_comes_again_is_written_once(spark, tmp_path):
    here, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    here.mkdir()
    now = time.time() - 10_000

    def run(**options):
        ingest.ingest_once(spark, str(here), out, state, within="1 hour", **options).awaitTermination(180)
        return sorted(r.path.rsplit("/", 1)[-1] for r in spark.read.parquet(out).collect())

    arrive(here, "a.sgf", GAME + OTHER, now)
    arrive(here, "bad.sgf", "(;B[aa", now)
    assert run() == ["a.sgf", "a.sgf"]
    # copies, in one trigger and in later ones of a query that was started again
    arrive(here, "b.sgf", GAME, now + 60)
    arrive(here, "c.sgf", TURNED + WIDER, now + 120)
    assert run(per_trigger=1) == ["a.sgf", "a.sgf", "c.sgf"]
    arrive(here, "d.sgf", OTHER, now + 180)
    assert run() == ["a.sgf", "a.sgf", "c.sgf"]
    # hours later the state has let go of them: the same game is a new one, and so bounded
    arrive(here, "e.sgf", "(;SZ[9];B[gg])", now + 9_000)
    assert run() == ["a.sgf", "a.sgf", "c.sgf", "e.sgf"]
    arrive(here, "f.sgf", GAME, now + 9_060)
    assert run() == ["a.sgf", "a.sgf", "c.sgf", "e.sgf", "f.sgf"]


def test_turned_games_are_others_by_their_plain_signature(spark, tmp_path):
    (tmp_path / "in").mkdir()
    arrive(tmp_path / "in", "a.sgf", GAME + TURNED + GAME, time.time())
    q = ingest.ingest_once(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), turned=False)
    q.awaitTermination(180)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    progress = [p for p in q.recentProgress if p["stateOperators"]]
    assert progress and progress[-1]["stateOperators"][0]["operatorName"] == "dedupeWithinWatermark"
