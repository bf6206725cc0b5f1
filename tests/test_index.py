"""The signature index and the points' bits: same rows as without them, and what they leave unread."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kifulake.operators import bitmap, moves, pattern
from kifulake.plans.collection import Collection
from kifulake.sources import index, writer

LETTERS = "abcdefghi"


def record(rng, size=9, setup=False):
    points = [a + b for a in LETTERS for b in LETTERS]
    rng.shuffle(points)
    stones = f"AB[{points.pop()}]AW[{points.pop()}]" if setup else ""
    n = rng.randrange(4, 30)
    return f"(;SZ[{size}]{stones}" + "".join(f";{'BW'[k % 2]}[{points[k]}]" for k in range(n)) + (";B[]" if n % 3 == 0 else "") + ")"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(8)
    d = tmp_path_factory.mktemp("indexed")
    records = [record(rng, setup=i % 4 == 0) for i in range(60)]
    records += [records[3], records[3], records[5], "(;SZ[9];B[ab];W[cd])", "(;SZ[9];B[ba];W[dc])", "(;SZ[25];B[yy])", "(;B[aa];W[ss])", "(;SZ[9];W[ab];B[cd])"]
    (d / "all.sgf").write_text("".join(records))
    files = Collection.of_files(spark, str(d))
    writer.write_database(files.games, str(d / "db"))
    index.write_index(files.games, str(d / "index"), buckets=8)
    return files, Collection.of_database(spark, str(d / "db")), Collection.of_index(spark, str(d / "index"), buckets=8)


def rows(c, *names):
    return sorted(tuple(r) for r in c.select("x", *names).collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_are_those_of_the_moves(stored):
    files, db, _ = stored
    for color, column in bitmap.COLUMNS.items():
        for r in db.games.select("moves", column).collect():
            words = [w & (1 << 64) - 1 for w in r[column]]
            got = {(x, y) for y in range(26) for x in range(32) if words[y // 2] >> (y % 2 * 32 + x) & 1}
            assert got == {(m.x, m.y) for m in r.moves if m.color == color and m.x is not None}


@pytest.mark.parametrize("color", [None, "B", "W"])
@pytest.mark.parametrize("text", ["ab", "ab,cd", "yy", "B9", "ab:1-5,cd", "ab:0-0", "tt", "ss", "aa:3-"])
def test_played_is_the_same_from_bits(stored, text, color):
    files, db, _ = stored
    wanted = files.games.where(moves.played(F.col("moves"), moves.positions(text, color), F.col("setup")))
    want = sorted(r.game_nr for r in wanted.collect())
    assert [x for (x,) in rows(files.where_played(text, color))] == want == [x for (x,) in rows(db.where_played(text, color))]


def test_played_reads_no_moves(stored):
    _, db, _ = stored
    read = plan(db.where_played("ab,cd").select("fn", "m")).split("ReadSchema")[1]
    assert "black" in read and "moves" not in read
    assert "moves" in plan(db.where_played("ab:1-5").select("fn")).split("ReadSchema")[1]


@pytest.mark.parametrize("text", ["(;SZ[9]AB[ab]AW[cd])", "(;SZ[9]AB[ab]AW[cd]AE[ii])", "(;SZ[9]AB[ee])", "(;SZ[9]AE[ee])", "(;SZ[9]AW[aa][bb])"])
@pytest.mark.parametrize("wide", [False, True])
def test_patterns_are_the_same_behind_bits(spark, stored, text, wide):
    files, db, _ = stored
    size, wanted = pattern.constraints(text)
    events = files.games.where("size = 9").select("game_id", F.explode(files.events()).alias("e")).select("game_id", "e.*")
    found = pattern.first_match(events, pattern.variants(wanted, size - 1, wide, wide))
    want = sorted((int(r.game_id.rsplit("#", 1)[1]), r.first_move) for r in found.collect())
    for c in (files, db):
        assert rows(c.where_pattern(text, all_symmetries=wide, swap=wide), "k") == want


def test_bits_spare_the_window_most_events(stored):
    _, db, _ = stored
    size, wanted = pattern.constraints("(;SZ[9]AB[ab]AW[cd])")
    able = db.games.where(bitmap.may_match(F.col("black"), F.col("white"), pattern.variants(wanted, size - 1)))
    assert 0 < able.count() < db.games.count() / 4


def test_signatures_are_stored(stored):
    files, db, idx = stored
    names = ("md5", "can", "canx", "m")
    assert rows(db, *names) == rows(files, *names) == rows(idx, *names)
    assert rows(db.truncated(keep=2), "md5") == rows(files.truncated(keep=2), "md5")
    assert rows(db.turned(3), "md5") == rows(files.turned(3), "md5")
    assert "moves" not in plan(db.select("can")).split("ReadSchema")[1]


def test_a_look_up_reads_one_bucket(stored):
    files, _, idx = stored
    can = files.where("x", "4").select("can").first().can
    found = idx.where("can", "=", can)
    assert rows(found) == [(4,), (61,), (62,)]
    md5 = files.where("x", "6").select("md5").first().md5
    assert rows(idx.where("md5", "=", md5)) == [(6,), (63,)]
    assert "EqualTo(md5" in plan(idx.where("md5", "=", md5).select("fn"))


def test_other_buckets_are_not_opened(spark, stored, tmp_path):
    files = stored[0]
    index.write_index(files.games, str(tmp_path / "index"), buckets=8)
    idx = Collection.of_index(spark, str(tmp_path / "index"), buckets=8)
    can = files.where("x", "4").select("can").first().can
    held = {r.f for r in idx.games.where(F.col("can") == can).select(F.input_file_name().alias("f")).collect()}
    others = set(idx.games.inputFiles()) - {f.replace("file:///", "file:/") for f in held} - held
    assert len(held) == 1 and others
    for f in others:
        with open(f.removeprefix("file:"), "wb") as out:
            out.write(b"no parquet")
        crc = f.removeprefix("file:").rsplit("/", 1)
        (tmp_path / "index" / f".{crc[1]}.crc").unlink(missing_ok=True)
    spark.catalog.refreshByPath(str(tmp_path / "index"))
    assert rows(idx.where("can", "=", can)) == [(4,), (61,), (62,)]
    with pytest.raises(Exception, match="(?i)parquet"):
        idx.games.where("md5 = 'x'").count()


def test_files_have_bloom_filters(spark, stored):
    _, db, idx = stored
    for c in (db, idx):
        assert c.games.where(F.col("md5") == "0" * 32).count() == 0
        for f in c.games.inputFiles():
            data = open(f.removeprefix("file:"), "rb").read()
            footer = pq.ParquetFile(f.removeprefix("file:")).metadata.serialized_size
            group = pq.ParquetFile(f.removeprefix("file:")).metadata.row_group(0)
            end = max(group.column(i).data_page_offset + group.column(i).total_compressed_size for i in range(group.num_columns))
            assert len(data) - footer - end > 2 * 32  # two filters of a block of 32 bytes or more stand behind the columns


def test_references_of_many_games(spark, stored, monkeypatch):
    files, _, idx = stored
    reference = files.where("x", "1-6")
    want = rows(files.like(reference, "can", every=True))
    assert want == rows(idx.like(reference, "can", every=True)) and len(want) == 9
    assert [x for (x,) in rows(files.like(files.where("x", "64"), "can"))] == [64, 65, 68]
    monkeypatch.setattr("kifulake.plans.collection.BROADCAST", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = idx.like(reference, "can", every=True)
        assert rows(found) == want
        # the references are dealt to the buckets, the index isn't shuffled
        p = plan(found.select("fn"))
        assert "BroadcastHashJoin" not in p and p.count("Exchange hashpartitioning(_0") >= 1 and "Exchange hashpartitioning(can" not in p
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_repeats_shuffle_nothing(stored):
    _, _, idx = stored
    found = index.repeated(idx.games)
    assert sorted(r.n for r in found.collect()) == [2, 3, 3] and "Exchange" not in plan(found)


def test_an_index_is_never_overwritten(spark, stored, tmp_path):
    files, _, _ = stored
    (tmp_path / "there").mkdir()
    (tmp_path / "there" / "x.parquet").write_text("")
    with pytest.raises(Exception, match="(?i)exist"):
        index.write_index(files.games, str(tmp_path / "there"))
