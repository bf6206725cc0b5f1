"""Cutting collections: by the byte, whole and in parts, with brackets in odd places."""

import random

import pytest
from pyspark.sql import functions as F

from kifulake.plans.collection import Collection
from kifulake.sources import sgf, split

VALUES = ["aa", "", "a(b", "x)y", "(;", ");", "see [1\\] 2", "a\\\\", "a] b", "line\nnext", "(;B[aa\\])", "李"]


def game(rng, depth=0):
    node = lambda: ";" + "".join(f"{rng.choice(['B', 'W', 'C', 'N'])}[{rng.choice(VALUES)}]" for _ in range(rng.randrange(1, 3)))
    inner = "".join(game(rng, depth + 1) for _ in range(rng.choice([0, 0, 2, 3]))) if depth < 3 else ""
    return "(" + "".join(node() + rng.choice(["", "\n"]) for _ in range(rng.randrange(1, 5))) + inner + ")"


def collection(seed, games=60):
    rng = random.Random(seed)
    gaps = ["", "\n", "\n\n", " \r\n", "\nFrom: me (at home)\n"]
    return "".join(game(rng) + rng.choice(gaps[: 4 if seed % 2 else 5]) for _ in range(games))


@pytest.mark.parametrize("seed", range(6))
def test_cut_keeps_every_byte(seed):
    data = collection(seed).encode()
    found = split.cut(data)
    assert b"".join(a + b for _, _, a, b in found) == data.rstrip() or b"".join(a + b for _, _, a, b in found) == data
    games = [b for nr, _, _, b in found if nr]
    assert len(games) == 60 and all(b.startswith(b"(") and b.endswith(b")") for b in games)
    # fed piece by piece, ends of pieces being closing brackets, the games are the same
    own, again = split.Cutter(), []
    for piece in data.split(b")"):
        again += [b for _, b in own.feed(piece + b")")]
    assert again == games


def test_cut_of_odd_texts():
    assert split.cut(b"") == [] and split.cut(b" \n") == []
    assert [(n, r, a) for n, r, a, _ in split.cut(b"mail\n(;B[aa])junk(;W[bb])")] == [(1, True, b"mail\n"), (2, False, b"junk")]
    assert split.cut(b"(;B[aa]) tail") == [(1, True, b"", b"(;B[aa])"), (0, False, b" tail", b"")]
    assert split.cut(b"(;B[aa](;W[bb])") == [(1, True, b"", b"(;B[aa](;W[bb])")]
    assert split.cut(b"nothing") == [(0, False, b"nothing", b"")]
    assert [b for *_, b in split.cut(b"(TE[x]B[aa])( ;B[cc])")] == [b"(TE[x]B[aa])", b"( ;B[cc])"]


def small_parts(spark, size):
    """Files in parts of so many bytes; what held before comes back."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], size)
    spark.conf.set(names[1], 1)
    return lambda: [spark.conf.set(n, v) for n, v in zip(names, before, strict=True)]


@pytest.mark.parametrize("end", ["", "\n", "(;B[aa](;W[bb]", "(;C[open", " trailing"])
@pytest.mark.parametrize("seed", range(2))
def test_parts_make_the_same_games(spark, tmp_path, seed, end):
    texts = {"a.sgf": collection(seed) + end, "b.sgf": "﻿" + collection(seed + 2, 30), "c.sgf": "(;C[one])", "d.sgf": collection(7, 3).strip(), "e.sgf": "no game here (at all) " * 30}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    shown = lambda df: sorted((r.path.rsplit("/", 1)[-1], r.n_games, r.game_nr, r.run, bytes(r.text)) for r in df.collect())
    whole = shown(split.texts(spark, str(tmp_path)))
    back = small_parts(spark, 700)
    try:
        parts = split.texts(spark, str(tmp_path), large=10)
        assert split._fragments(spark, [f"file:{tmp_path}/a.sgf"]).rdd.getNumPartitions() > 8
        assert shown(parts) == whole
    finally:
        back()


def test_a_file_whose_parts_deceive_is_read_in_order(spark, tmp_path):
    # one game of a hundred kilobytes, all of it variations: most parts begin and end inside it
    rng = random.Random(3)
    inner = lambda d: "(;B[aa]C[)](;W[bb])" + "".join(inner(d + 1) for _ in range(3)) + ")" if d < 6 else "(;C[x])"
    one = "(;GM[1]" + inner(0) + inner(1) + ")"
    text = collection(1, 5) + one + collection(3, 5) + "".join(f"(;C[{')(;' * rng.randrange(400)}])" for _ in range(40))
    (tmp_path / "a.sgf").write_bytes(text.encode())
    want = [bytes(b) for *_, b in split.cut(text.encode())]
    back = small_parts(spark, 2000)
    try:
        got = split.texts(spark, str(tmp_path), large=10).orderBy("game_nr").collect()
        assert [bytes(r.text) for r in got if r.game_nr] == [b for b in want if b]
        ordered = split._in_order(split._fragments(spark, [f"file:{tmp_path}/a.sgf"])).orderBy("i").collect()
        assert [bytes(r.text) for r in ordered] == want
    finally:
        back()


def test_collections_in_parts_answer_as_whole_ones(spark, tmp_path):
    rng = random.Random(5)
    games = ["(;SZ[9]DT[2003-07-%02d]PB[p%d]" % (i % 28 + 1, i) + "".join(f";{'BW'[k % 2]}[{rng.choice('abcdefghi')}{rng.choice('abcdefghi')}]" for k in range(rng.randrange(20))) + "(;C[x])(;C[y]))\n" for i in range(80)]
    (tmp_path / "a.sgf").write_text("".join(games[:70]))
    (tmp_path / "b.sgf").write_text("".join(games[70:]))
    ask = lambda c: sorted(tuple(r) for r in c.where("propDT", ":", "07-0").where("m", "3-").select("fn", "x", "N", "m", "can", "propPB", "sz").collect())
    whole = ask(Collection.of_files(spark, str(tmp_path)))
    back = small_parts(spark, 1500)
    try:
        assert ask(Collection.of_files(spark, str(tmp_path), large=100)) == whole and len(whole) > 10
    finally:
        back()
    assert ask(Collection(sgf.games(sgf.scan(spark, str(tmp_path))))) == whole


def test_text_between_games(spark, tmp_path):
    (tmp_path / "a.sgf").write_text("(;B[aa]) -- (;B[bb])(;B[cc]) end")
    count = lambda **o: Collection.of_files(spark, str(tmp_path), **o).games.count()
    assert (count(), count(many=True)) == (1, 3)
    back = small_parts(spark, 9)
    try:
        assert (count(large=1), count(many=True, large=1)) == (1, 3)
    finally:
        back()


def test_names_in_any_character_set(spark, tmp_path):
    name, other = "李世乭", "井山裕太"
    for file, codec, who in (("u.sgf", "utf-8", name), ("g.sgf", "gbk", "常昊"), ("s.sgf", "shift_jis", other), ("k.sgf", "euc_kr", "이창호"), ("l.sgf", "latin-1", "Müller")):
        said = {"utf-8": "UTF-8", "gbk": "GBK", "shift_jis": "Shift_JIS", "euc_kr": "EUC-KR", "latin-1": "ISO-8859-1"}[codec]
        (tmp_path / file).write_bytes(f"(;CA[{said}]PB[{who}]C[ソ表]DT[2001-02-03];B[aa])".encode(codec, "replace"))
    c = Collection.of_files(spark, str(tmp_path))
    file = lambda found: [r.fn.rsplit("/", 1)[-1] for r in found.select("fn").collect()]
    for who, where in ((name, "u.sgf"), ("常昊", "g.sgf"), (other, "s.sgf"), ("이창호", "k.sgf"), ("Müller", "l.sgf")):
        assert file(c.where("propPB", "=", who)) == [where]
        assert file(c.where("propPB", ":", who[:2])) == [where]
    assert len(file(c.where("propDT", "=", "2001-02-03"))) == 5
    # a second byte that looks like a bracket or a backslash is none, and comes out once encoded
    assert c.where("fn", ":", "s.sgf").select("propC").first().propC == "ソ表"
    from kifulake.sources import writer

    writer.write_games(c.where("propPB", "=", name).games, str(tmp_path / "out"))
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert f"PB[{name}]" in text
    assert sgf.parse(f"(;PB[{name}])".encode())[0]["nodes"][0]["props"][0]["vals"] == [name]


def test_only_what_is_asked_for_is_built(spark, tmp_path):
    (tmp_path / "a.sgf").write_text("(;PB[x]DT[2003])")
    c = Collection.of_files(spark, str(tmp_path))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    # the cut of the file, and one column of its games each
    assert plan(c.select("fn")).count("ArrowEvalPython") == 1
    assert plan(c.select("fn", "sz")).count("ArrowEvalPython") == 2
    asked = plan(c.where("propDT", "=", "2003").select("fn"))
    assert "Contains" in asked or "contains" in asked
    assert asked.index("udf(text") < asked.index("ontains(text") if "udf(text" in asked else True
    listing = split.texts(spark, str(tmp_path)).where(F.col("path").contains("a.sgf"))
    assert listing.count() == 1


def odd_records():
    rng = random.Random(11)
    roots = ["SZ[9]", "SZ[9]AB[aa][bb:cc]AW[dd]", "GM[1]C[a\\]b]SZ[21]", "ga[x]", "G M[1]", "", "C[a] b]", "B[cc]W[dd]", " PB [x] [y] ", "KM[0.5]\n\nRE[B+R]", "SZ[9]C[(;B[aa\\])]", "AB[aa]\r\n", "Sz[19]C[open"]
    bodies = ["", ";B[aa];W[bb]", ";B[];W[tt];B[pass]", ";B[a];W[bb]\n;B[cc] ", ";B[aa]C[x];W[bb]", ";B[aa](;W[bb])(;W[cc])", ";B[aa];;W[bb]", ";B[aa][bb]", ";b[aa]", ";B [aa]", ";AB[ee];W[ff]", "; B[aa];W[ bb ]", ";B[AA]", "B[aa]"]
    ends = [")", ") ", "\n)\n", "", ")x"]
    return ["(" + ";" + r + b + e for r in roots for b in bodies for e in rng.sample(ends, 3)] + ["", "x", "(", "( ;B[aa])", "(TE[x]B[aa])"]


@pytest.mark.parametrize("full_ids", [False, True])
@pytest.mark.parametrize("second_node", [False, True])
def test_columns_are_those_of_the_whole_parse(spark, full_ids, second_node):
    records = odd_records()
    texts = spark.createDataFrame([("p", 1, i, t.encode()) for i, t in enumerate(records)], "path string, n_games int, game_nr int, text binary")
    props = [sgf.first_value(F.col("text"), n, w, full_ids).alias(f"{n}_{w}") for n in ("C", "SZ", "B", "PB", "AB") for w in ("all", "root", "rest")]
    found = sgf.typed(texts, full_ids, second_node).select("*", *props).orderBy("game_nr").collect()
    for t, r in zip(records, found, strict=True):
        parsed = sgf.parse(t.encode(), second_node=second_node, full_ids=full_ids)
        want = parsed[0] if parsed else {"size": 19, "abct": 0, "awct": 0, "setup": 0, "moves": [], "nodes": [], "parse_error": "no game found"}
        for name in ("size", "abct", "awct", "setup", "parse_error"):
            if name == "parse_error" or want["parse_error"] is None:
                assert r[name] == want[name], (t, name)
        assert [m.asDict() for m in r.moves] == want["moves"] and [n.asDict(True) for n in r.nodes] == want["nodes"], t
        assert r.movect == sum(len(p["vals"]) for n in want["nodes"] if n["is_main"] for p in n["props"] if p["id"] in ("B", "W")), t
        if want["parse_error"] is None:
            for n in ("C", "SZ", "B", "PB", "AB"):
                some = {"all": want["nodes"], "root": want["nodes"][:1], "rest": want["nodes"][1:]}
                for w, nodes in some.items():
                    assert r[f"{n}_{w}"] == next((p["vals"][0] for x in nodes for p in x["props"] if p["id"] == n), None), (t, n, w)
