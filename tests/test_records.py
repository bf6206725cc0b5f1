"""Whole records through scan, parse, replay, queries, database and writers."""

import pytest
from pyspark.sql import functions as F

from kifulake.functions import points
from kifulake.operators import board, check, compare, edit, moves, pattern, properties, render, tree
from kifulake.plans import bridge
from kifulake.plans.collection import Collection
from kifulake.sources import foreign, sgf, writer
from kifulake.streaming import ingest
from tests.test_parser import TREE

CAPTURE = "(;SZ[5]PB[a]PW[b]RE[B+3.5]KM[0.5]DT[2003-07-22];B[ab];W[aa];B[ba];W[cc];B[cd];W[ee])"
TWIN = CAPTURE.replace("KM[0.5]", "KM[1.5]")
TURNED = "(;SZ[5]PB[c]PW[d]RE[W+R];B[db];W[da])(;SZ[5];B[cc])"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("records")
    (d / "sub").mkdir()
    for name, text in {"a.sgf": CAPTURE, "b.sgf": TWIN, "c.sgf": TURNED, "t.sgf": TREE, "sub/d.sgf": CAPTURE, "x.txt": CAPTURE}.items():
        (d / name).write_text(text)
    return str(d)


@pytest.fixture(scope="module")
def all_games(spark, folder):
    return Collection.of_files(spark, folder)


def names(df, column="path"):
    return sorted(r[column].rsplit("/", 1)[-1] for r in df.select(column).collect())


def test_scan(spark, folder):
    assert names(sgf.scan(spark, folder)) == ["a.sgf", "b.sgf", "c.sgf", "t.sgf"]
    assert len(names(sgf.scan(spark, folder, recursive=True))) == 5
    assert "x.txt" in names(sgf.scan(spark, folder, extension=""))


def test_selection(all_games):
    assert names(all_games.where("propDT", "=", "2003-07-22").games) == ["a.sgf", "b.sgf"]
    assert names(all_games.where("rpropKM", "!").games) == ["c.sgf", "c.sgf", "t.sgf"]
    assert names(all_games.where("propRE", "!=", "W+R").games) == ["a.sgf", "b.sgf"]
    assert names(all_games.where("m", "6-").games) == ["a.sgf", "b.sgf"]
    assert names(all_games.where("x", "2").games) == ["c.sgf"]
    assert names(all_games.where("winner", "=", "a").games) == ["a.sgf", "b.sgf"]
    assert names(all_games.where("loser", "=", "c").games) == ["c.sgf"]
    assert names(all_games.where("player", ":", "c,d").games) == ["c.sgf"]
    assert names(all_games.where_played("cd").games) == ["a.sgf", "b.sgf"]
    assert names(all_games.where_played("cc:1-1").games) == ["c.sgf"]
    assert names(all_games.like(all_games.where("fn", ":", "a.sgf"), "md5").games) == ["a.sgf", "b.sgf"]


def test_projection(all_games):
    row = all_games.where("fn", ":", "a.sgf").select("sz", "m", "h", "prop", "rprop", "propPB", "M1,2,9", "s", "DsA", "capt", "Wcapt").first()
    assert tuple(row) == (5, 6, 0, "SZ PB PW RE KM DT", "SZ PB PW RE KM DT", "a", "ab aa ??", "abaabacccdee", "??????", 1, 1)
    assert all_games.where("fn", ":", "t.sgf").select("mprop", "mpropAB", "h").first() == ("AB-5 AW-7", "AB[ab][bb][cb][da][db]", 0)
    assert sorted(r.N for r in all_games.count_per_file().collect()) == [1, 1, 1, 2]
    can = {r.fn.rsplit("/")[-1]: r for r in all_games.where("fn", "!:", "c.sgf").select("fn", "can", "canx", "md5").collect()}
    assert can["a.sgf"].can == can["b.sgf"].can == can["a.sgf"].canx[:32]
    assert "  a.sgf" in "  " + all_games.where("fn", ":", "a.sgf").lines("sz").first().value.rsplit("/")[-1]


def test_replay_and_final_position(all_games):
    row = all_games.where("fn", ":", "a.sgf").select("P").first()
    assert row.P == "(;SZ[5]AB[ab][ba][cd]AW[cc][ee])"
    g = board.with_plays(all_games.where("fn", ":", "a.sgf").games)
    at3 = g.select(board.final_stones(F.col("plays.events"), 2).alias("s")).first().s
    assert [(x.color, x.x, x.y) for x in at3] == [("W", 0, 0), ("B", 0, 1)]


@pytest.mark.parametrize(("record", "rule"), [
    ("(;SZ[5];B[aa];W[aa])", "occupied"),
    ("(;SZ[5];B[fa])", "off board"),
    ("(;SZ[5];B[ab];W[ee];B[ba];W[aa])", "suicide"),
    ("(;SZ[25];B[aa])", "size"),
    ("(;SZ[5]AB[ba][ab][bc]AW[ca][db][cc];B[cb];W[bb];B[cb])", "ko"),
])
def test_illegal_moves(record, rule):
    (g,) = sgf.parse(record)
    assert board.replay(g["size"], g["moves"], g["setup"])["error_rule"] == rule


def test_passes_and_cycles_are_legal():
    (g,) = sgf.parse("(;SZ[5];B[aa];W[];B[tt])")
    out = board.replay(g["size"], g["moves"], g["setup"])
    assert out["error"] is None and [e["is_pass"] for e in out["events"]] == [False, True, True]


def test_pattern(spark, all_games):
    found = all_games.where_pattern("(;SZ[5]AB[ab][ba]AE[aa])").games
    assert names(found) == ["a.sgf", "b.sgf"] and {r.k for r in found.collect()} == {3}
    assert names(all_games.where_pattern("(;SZ[5]AB[da]AW[db])", all_symmetries=True, swap=True).games) == ["c.sgf"]
    with pytest.raises(ValueError):
        pattern.constraints("(;AB[aa](;B[bb])(;B[cc]))")


def test_database(spark, all_games, tmp_path):
    to = str(tmp_path / "db")
    writer.write_database(all_games.games, to)
    db = Collection.of_database(spark, to)
    assert db.games.count() == 5
    assert {r.md5 for r in db.select("md5").collect()} == {r.md5 for r in all_games.select("md5").collect()}
    assert sorted(r.capt for r in db.select("capt").collect()) == [0, 0, 0, 1, 1]
    again = db.games.select(writer.moves_from_events(F.col("events")).alias("m"), "moves").collect()
    assert all(r.m == r.moves for r in again)
    with pytest.raises(ValueError):
        db.value("propDT")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        writer.write_database(all_games.games, to)


def test_serialiser_round_trip(spark, all_games):
    for r in all_games.games.select("nodes", writer.text(F.col("nodes")).alias("t")).collect():
        (back,) = sgf.parse(r.t)
        assert [n["props"] for n in back["nodes"]] == [[{"id": p.id, "vals": p.vals} for p in n.props] for n in r.nodes]
        assert [(n["parent"], n["var_lo"], n["var_hi"]) for n in back["nodes"]] == [(n.parent, n.var_lo, n.var_hi) for n in r.nodes]


def test_tree_walk(all_games):
    t = all_games.where("fn", ":", "t.sgf").games
    n = F.col("nodes")
    row = t.select(
        tree.n_variations(n), tree.n_moves(n, 1), tree.properties_at(n, 1, 0), tree.properties_at(n, 1, 0, "AB"), F.array_join(tree.replies(n), " "),
        tree.properties_at(n, 1, 1), tree.properties_at(n, 1, 1, "C"), F.array_join(tree.replies(n, ["aa"]), " "), tree.properties_at(n, 2, 2, "C"), tree.first_difference(n, 1, 3), F.size(tree.moves_with_properties(n, 2)),
    ).first()
    assert tuple(row) == (4, 1, "SZ AB AW PL C", "ab, bb, cb, da, db", "ba aa ca gg", "W C", "Correct", "ba", "B lives", 1, 1)
    labels = [r.label for r in tree.tree_rows(sgf.nodes(t)).orderBy("run").collect()]
    assert labels == ["-", "  1-1", "  1-2", "  1-2", "  1-1"]
    assert edit.variations(t).count() == 4


def test_edits(all_games):
    t = all_games.where("fn", ":", "t.sgf").games.withColumn("nodes", edit.without_variations(F.col("nodes")))
    stripped = edit.stripped(F.col("nodes"), [edit.StripRule.parse("C"), edit.StripRule.parse("PL=W")])
    assert t.select(properties.ids(stripped)).first()[0] == "SZ AB AW"
    kept = edit.stripped(F.col("nodes"), [edit.StripRule.parse("C:kan")])
    assert t.select(properties.ids(kept, "all", True)).first()[0] == "SZ AB AW PL W C"
    turned = edit.transformed_nodes(F.col("nodes"), 5, F.col("size"), swap_colors=True)
    assert t.select(properties.first_all(turned, "AW")).first()[0] == "AW[gb][fb][eb][da][db]"


def test_rectangles_and_labels_turn(spark):
    g = spark.createDataFrame([(sgf.parse("(;AB[aa:cb]LB[aa:A]AR[aa:cb]W[tt])")[0]["nodes"],)], f"nodes array<{sgf.NODE}>")
    out = g.select(edit.transformed_nodes(F.col("nodes"), 5, 19).alias("n")).first().n[0].props
    assert [(p.id, p.vals) for p in out] == [("AB", ["qa:sb"]), ("LB", ["sa:A"]), ("AR", ["sa:qb"]), ("W", ["tt"])]


def test_root_order_and_push_down(spark):
    nodes = sgf.parse("(;GM[1]B[aa]RE[B+1]PB[x]AW[cc][bb]XX[1]PB[y]PW[];W[bb])")[0]["nodes"]
    g = spark.createDataFrame([(nodes,)], f"nodes array<{sgf.NODE}>")
    c = edit.ordered_root(edit.sorted_stones(edit.pushed_down(F.col("nodes"))))
    out = g.select(c.alias("n")).first().n
    assert [[(p.id, p.vals) for p in n.props] for n in out] == [[("PB", ["y"]), ("RE", ["B+1"]), ("AW", ["bb", "cc"]), ("XX", ["1"])], [("B", ["aa"])], [("W", ["bb"])]]
    assert [(n.node_id, n.parent) for n in out] == [(0, -1), (1, 0), (2, 1)]


def test_layout_of_the_published_example():
    head = "(;\nPB[Cho Chikun]\nBR[9d]\nPW[Takemiya Masaki]\nWR[9d]\nKM[5.5]\nRE[B+11.5]\nDT[1996-10-02,03]\n\n"
    body = ";B[pd];W[dp];B[pp];W[dd];B[fq];W[dn];B[jp];W[qk];B[qm];W[pg]\n;B[gq];W[dk];B[gj];W[dl];\nC[...]\n)\n"
    (g,) = sgf.parse(head + body)
    assert writer.serialised(g["nodes"]) == head + body
    (g,) = sgf.parse("(;AB[aa];B[bb]BL[9]C[x]N[y];W[cc](;B[dd])(;B[ee]))")
    assert writer.serialised(g["nodes"]) == "(;\nAB[aa]\n\n;B[bb]BL[9]\nC[x]\nN[y]\n;W[cc](;B[dd])\n(;B[ee])\n)\n"


def test_root_order_of_the_published_example(spark):
    text = "(;PB[Cho Chikun]BR[9th dan]PW[Takemiya Masaki]WR[9-Dan]DT[2/3 October 1996]\nKM[5 1/2]RE[B+11.5]HA[2]ID[x]EVX[y]JD[z]SZ[19]FF[4];B[pd])"
    g = spark.createDataFrame([(sgf.parse(text)[0]["nodes"],)], f"nodes array<{sgf.NODE}>")
    out = g.select(edit.ordered_root(F.col("nodes")).alias("n")).first().n[0].props
    assert [p.id for p in out] == ["FF", "EVX", "ID", "PB", "BR", "PW", "WR", "KM", "RE", "JD", "DT", "HA", "SZ"]


def test_handicap_stones_of_each_format(spark, tmp_path):
    ngf = "t\n19\nw 7段\nb 5段\nsite\n6\n0\n0\n20110812\n480\n白5.5目勝ち!\n0\n"
    (tmp_path / "a.ngf").write_bytes(ngf.encode("cp932"))
    text = foreign.converted(sgf.scan(spark, str(tmp_path), extension=".ngf"), "ngf").first().text
    assert "AB[pj][dj][dd][pp][dp][pd]" in text and foreign.stones(6) == ["dd", "pd", "dj", "pj", "dp", "pp"]


def test_comparison(spark):
    one = lambda s: sgf.parse(s)[0]["moves"]
    df = spark.createDataFrame([(one("(;B[aa];W[bb];B[cc])"), one("(;B[aa];W[bd])"), one("(;B[aa];W[bb])"))], f"a array<{sgf.MOVE}>, b array<{sgf.MOVE}>, c array<{sgf.MOVE}>")
    a, b, c = map(F.col, "abc")
    row = df.select(compare.differences(a, b), compare.common_prefix(a, b), compare.histogram_distance(a, b), compare.verdict(a, a), compare.verdict(a, c), compare.merged_moves(c, a)["moves"], compare.merged_moves(a, b)).first()
    assert [tuple(x) for x in row[0]] == [(2, "bb", "bd"), (3, "cc", "--")]
    assert tuple(row[1:5]) == (1, 3, "identical", "truncation")
    assert [m.mv for m in row[5]] == ["aa", "bb", "cc"] and row[6] is None
    notes = df.select(compare.merged_moves(a, b, 1)["notes"]).first()[0]
    assert notes == ["move 2: bb / bd"]


def test_best_symmetry_in_the_row(spark):
    """eight distances a pair without unnesting or shuffling; against counts of letters."""
    import random
    from collections import Counter

    from kifulake.functions.points import FIXED, mirrored

    rng = random.Random(5)
    moves = lambda n: [("B", x := rng.randrange(19), y := rng.randrange(4), chr(97 + x) + chr(97 + y)) if rng.random() < 0.9 else ("W", None, None, rng.choice(FIXED)) for _ in range(n)]
    games = {k: (moves(rng.randrange(12)), moves(rng.randrange(12))) for k in range(300)} | {300: ([], []), 301: ([], moves(3)), 302: (moves(700), moves(600))}
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in games.items()] + [(303, None, moves(2))], f"pair long, a array<{sgf.MOVE}>, b array<{sgf.MOVE}>")
    found = compare.best_symmetry(df, most=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan

    def apart(a, b, t):
        turn = lambda m: m[3] if m[1] is None or m[3] in FIXED else "".join(chr(97 + z) for z in mirrored(t, m[1], m[2], 18))
        x, y = Counter(map(turn, a)), Counter(m[3] for m in b)
        return sum(((x - y) + (y - x)).values())

    want = {}
    for k, (a, b) in games.items():
        d, t = min((apart(a, b, t), t) for t in range(8))
        cut = (None, None)
        if t and d > 4 and len(a) != len(b):
            n = min(len(a), len(b))
            e, u = min((apart(a[:n], b[:n], u), u) for u in range(8))
            zero = apart(a[:n], b[:n], 0)
            cut = (0, zero) if zero <= 4 else (u, e)
        want[k] = (t, d, *cut)
    assert {r.pair: (r.t, r.distance, r.t_cut, r.distance_cut) for r in found.collect()} == want
    block, compare.BLOCK = compare.BLOCK, 50
    try:  # however few moves are looked at at once
        lists = [df.where("a is not null").select("a.x", "a.y", "a.mv", F.col("b.mv").alias("o")).toArrow().column(i).combine_chunks() for i in range(4)]
        assert [(int(d.argmin()), int(d.min())) for d in compare.distances(*lists)] == [v[:2] for v in want.values()]
    finally:
        compare.BLOCK = block


def test_comparison_of_shifted_and_mirrored_games(spark):
    import random

    rng = random.Random(4)
    points = [chr(97 + x) + chr(97 + y) for x in range(19) for y in range(19)]
    game = lambda mvs, same=False: sgf.parse("(" + "".join(f";{'B' if same or i % 2 == 0 else 'W'}[{m}]" for i, m in enumerate(mvs)) + ")")[0]["moves"]
    mirror = lambda mvs: [m[0] + chr(97 + 115 - ord(m[1])) for m in mvs]
    base = [f"{chr(97 + i % 9)}{chr(97 + i // 9)}" for i in range(60)]
    tail = rng.sample([p for p in points if p not in base and p not in mirror(base)], 40)
    shift = [*base[20:], *base[:20]]
    rows = [("mirrored", game(mirror(base)), game(base)), ("longer", game([*mirror(base), *tail]), game(base)), ("shifted", game(base), game(shift)), ("colors", game(base, True), game(shift)), ("other", game(base), game(rng.sample(tail, 30)))]
    df = spark.createDataFrame(rows, f"pair string, a array<{sgf.MOVE}>, b array<{sgf.MOVE}>")
    said = {r.pair: r.verdict for r in compare.best_symmetry(df).collect()}
    assert (said["mirrored"], said["longer"], said["shifted"]) == ("transformed", "truncated", "same orientation")
    full = {r.pair: r.verdict for r in compare.compared(df).collect()}
    assert (full["mirrored"], full["longer"], full["shifted"], full["colors"]) == ("identical", "truncation", "chunks", "non-alternating")
    got = [(r.type, r.k1, r.k2, r.length) for r in compare.chunks(df.where("pair = 'shifted'")).collect()]
    assert got == [(3, 1, 41, 20), (3, 21, 1, 40)]
    # grown over repeated moves and passes; a move that differs between two anchors ends a chunk
    assert [tuple(c.values()) for c in compare.chunks_of(["aa", "tt", "bb", "tt", "cc"], ["aa", "tt", "bb", "dd", "cc"])] == [(3, 1, 1, 3), (1, 4, None, 1), (3, 5, 5, 1), (2, None, 4, 1)]
    for _ in range(200):  # each move of the first game is in one chunk, and common chunks are equal and can't grow
        x, y = ([rng.choice(points[:12]) for _ in range(rng.randrange(12))] for _ in range(2))
        found = compare.chunks_of(x, y)
        own = [k for c in found if c["type"] != 2 for k in range(c["k1"], c["k1"] + c["length"])]
        assert own == list(range(1, len(x) + 1))
        lone = [k for c in found if c["type"] == 2 for k in range(c["k2"], c["k2"] + c["length"])]
        both = {c["k2"] + i for c in found if c["type"] == 3 for i in range(c["length"])}
        assert sorted({*lone, *both}) == list(range(1, len(y) + 1)) and not both & set(lone)
        for c in found:
            if c["type"] == 3:
                p, q, n = c["k1"] - 1, c["k2"] - 1, c["length"]
                assert x[p : p + n] == y[q : q + n] and (p + n == len(x) or q + n == len(y) or x[p + n] != y[q + n])
                assert any(x.count(m) == 1 == y.count(m) for m in x[p : p + n])


def test_replies_behind_many_nodes_without_a_move(spark):
    nodes = sgf.parse("(;C[r]" + ";C[x]" * 7 + "(;B[aa]" + ";C[y]" * 6 + "(;W[bb];B[dd])(;C[z];W[cc]))(;B[ee]))")[0]["nodes"]
    g = spark.createDataFrame([(nodes,)], f"nodes array<{sgf.NODE}>")
    n = F.col("nodes")
    row = g.select(tree.replies(n), tree.replies(n, ["aa"]), tree.replies(n, ["aa", "bb"]), tree.replies(n, ["zz"])).first()
    assert tuple(row) == (["aa", "ee"], ["bb", "cc"], ["dd"], [])


def test_text_queries_run_over_all_documents(spark, tmp_path):
    rows = [(i, f"a\nb\r{i}\n", f"src{i % 3}/x") for i in range(0, 1200, 7)] + [(None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.text) for r in bridge.QUERIES["replace_nl"](spark, str(tmp_path)).collect()}
    assert got == {(i, t and t.replace("\n", " ").replace("\r", " ")) for i, t, _ in rows}
    got = {(r.doc_id, r.source) for r in bridge.QUERIES["filter_filename"](spark, str(tmp_path)).collect()}
    assert got == {(i, s) for i, _, s in rows if s and "src1" in s}


def test_validation(spark, tmp_path):
    records = {"dup": "(;C[a]C[b])", "mixed": "(;SZ[9];B[aa]AW[bb])", "root": "(;SZ[9]B[aa])", "twice": "(;SZ[9];B[aa];B[bb])", "white": "(;SZ[9];W[aa])", "ha": "(;HA[2]AB[aa][bb];B[cc])", "km": "(;KM[6.5]RE[B+3])", "kmsyntax": "(;KM[six])", "re": "(;RE[hello])", "resign": "(;RE[B+R];B[aa];W[bb])", "sz": "(;SZ[99])", "bad": "(;B[aa", "occupied": "(;SZ[9];B[aa];W[aa])", "fine": "(;SZ[9]KM[6.5]RE[W+2.5];B[aa];W[bb])", "quarter": "(;KM[2.75]RE[W+0.25])"}
    for name, text in records.items():
        (tmp_path / f"{name}.sgf").write_text(text)
    files = sgf.scan(spark, str(tmp_path))
    found = check.issues(sgf.games(files, strict=True)).cache()
    rules = {}
    for r in found.collect():
        rules.setdefault(r.path.rsplit("/")[-1][:-4], set()).add(r.rule)
    want = {"dup": "duplicate", "mixed": "mixed", "root": "root_move", "twice": "same_color", "white": "first_color", "ha": "first_color", "km": "komi_result", "kmsyntax": "komi_syntax", "re": "result_syntax", "resign": "resign", "sz": "size", "bad": "grammar", "occupied": "occupied"}
    assert all(rule in rules.get(name, ()) for name, rule in want.items()), rules
    assert names(check.files_without(files, found)) == ["fine.sgf", "quarter.sgf"]
    assert check.exit_code(found) == -1
    assert check.assert_count(files, 15, 15) == 0 and check.assert_count(files, 16) == -1 and check.assert_count(files) == 1


def test_conversions(spark, tmp_path):
    ngf = "title\r\n19\r\nwhite 7段*\r\nblack 5段P\r\nsite\r\n0\r\n0\r\n6\r\n20110812 [09:31]\r\n480\r\n黒中押し勝ち!\r\n2\r\nPMABBQEEQ\r\nPMACWEEEE\r\n"
    empty = "0" * 361
    nip = f"NIP100;\nTitle=t;\nStart=2014/01/20;\nEnd=2014/01/20;\nPlayer1=a;\nPlayer2=b;\nResult=2:1;\np={empty}qd;\nh1=0;\nh2=0;\nEND\n"
    gib = "\\HS\n\\[GAMEBLACKNAME=b (9D)\\]\n\\[GAMEDATE=2017- 1- 6-12- 6-22\\]\n\\[GAMERESULT=white 3.5 win\\]\n\\HE\n\\GS\n2 1 0\n3 0 &4\nINI 0 1 2 &4\nSTO 0 2 2 15 3\nSKI 0 3\n\\GE\n"
    ugi = "[Header]\nTitle=t\nSize=19\nPlayerB=b,9d\nPlayerW=w,8d\nHdcp=0,6.5\nWinner=B,C\n[Data]\nAA,W2,0,0\nPP,B1,1,0\nYA,W2,2,0\n"
    nk = "(;TE[x]RD[2001-01-01];B[aa])"
    for name, data in {"a.ngf": ngf.encode("cp932"), "a.nip": nip.encode(), "a.gib": gib.encode(), "a.ugi": ugi.encode("cp932"), "a.nk": nk.encode(), "b.ngf": b"no"}.items():
        (tmp_path / name).write_bytes(data)
    out = {}
    for kind in ("ngf", "nip", "gib", "ugi", "nk"):
        for r in foreign.converted(sgf.scan(spark, str(tmp_path), extension=f".{kind}"), kind).collect():
            out[r.path.rsplit("/")[-1]] = r
    assert out["b.ngf"].text is None and out["b.ngf"].error
    first = lambda name: {p["id"]: p["vals"] for p in sgf.parse(out[name].text.encode())[0]["nodes"][0]["props"]}
    mv = lambda name: [(m["color"], m["mv"]) for m in sgf.parse(out[name].text.encode())[0]["moves"]]
    assert first("a.ngf") | {} and first("a.ngf")["KM"] == ["6.5"] and first("a.ngf")["RE"] == ["B+R"] and first("a.ngf")["DT"] == ["2011-08-12"]
    assert mv("a.ngf") == [("B", "pd"), ("W", "dd")]
    assert first("a.nip")["RE"] == ["W+1.5"] and mv("a.nip") == [("B", "qd")]
    assert first("a.gib")["DT"] == ["2017-01-06 12:06:22"] and first("a.gib")["RE"] == ["W+3.5"] and mv("a.gib")[-2:] == [("W", "pd"), ("B", "tt")]
    assert first("a.ugi")["AW"] == ["aa"] and first("a.ugi")["RE"] == ["B+R"] and mv("a.ugi")[1:] == [("B", "pp"), ("W", "tt")]
    assert first("a.nk")["EV"] == ["x"] and first("a.nk")["DT"] == ["2001-01-01"]


def test_svg(all_games):
    g = board.with_plays(all_games.where("fn", ":", "a.sgf").games)
    svg = g.select(render.diagram(F.col("size"), F.col("plays.events"), 3, 5, True).alias("s")).first().s
    assert svg.startswith("<svg") and svg.count("<circle") == 5 and ">1</text>" in svg


def test_plan_drops_what_is_not_asked_for(spark, all_games):
    plan = all_games.games.withColumn("p", board.plays(F.col("size"), F.col("moves"), F.col("setup"))).select("path")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # the parse, whose array is exploded; the replay is gone


def test_stream(spark, folder, tmp_path):
    q = ingest.ingest(spark, folder, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_listing():
    assert moves.ranges("3,5-7,9-") == [(3, 3), (5, 7), (9, None)]


def _one(spark, text, tmp_path, **options):
    (tmp_path / "g.sgf").write_text(text)
    return Collection.of_files(spark, str(tmp_path), **options)


@pytest.mark.parametrize(
    ("root", "want"),
    [
        ("RE[Unfinished]", set()), ("RE[Game suspended at move 10]", set()), ("RE[Both lost]", set()), ("RE[Not played]", set()), ("RE[B+bye]", set()), ("RE[W+]", set()),
        ("RE[jigo]", {("result_syntax", "warning")}), ("RE[J]", {("result_syntax", "warning")}), ("RE[Black wins]", {("result_syntax", "error")}), ("RE[B+3x]", {("result_syntax", "error")}),
        ("KM[x]", {("komi_syntax", "warning")}), ("KM[5.]", set()), ("KM[5][6]", {("single_value", "error")}), ("RE[B+R][W+R]", {("single_value", "error")}), ("SZ[50]", {("size", "error")}),
        ("HA[x]", {("handicap_syntax", "warning")}), ("HA[30]AB[dd]AW[ee]", {("handicap_syntax", "warning")}),
    ],
)
def test_severities(spark, tmp_path, root, want):
    games = _one(spark, f"(;{root}C[a];C[b])", tmp_path).games.withColumns({"issues": F.expr("cast(array() as array<struct<severity:string,rule:string,line:int,message:string>>)")})
    kept = {"result_syntax", "komi_syntax", "single_value", "size", "handicap_syntax"}
    assert {(r.rule, r.severity) for r in check.issues(games).collect() if r.rule in kept} == want


def test_first_rule_of_a_name_decides_on_the_first_value(spark, tmp_path):
    games = _one(spark, "(;AB[aa][bb]C[x]PL[B])", tmp_path).games
    left = lambda *rules: [p.id for p in games.select(F.inline(edit.stripped(F.col("nodes"), [edit.StripRule.parse(r) for r in rules]))).first().props]
    assert left("AB=bb") == ["AB", "C", "PL"] and left("AB=aa") == ["C", "PL"]
    assert left("C=y", "C") == ["AB", "C", "PL"] and left("C:x", "PL=W") == ["AB", "PL"]


def test_stones_of_neighbours_merge(spark, tmp_path):
    games = _one(spark, "(;AB[cc]AB[aa][aa]C[x]AB[bb])", tmp_path).games
    shown = lambda **o: [(p.id, p.vals) for p in games.select(F.inline(edit.sorted_stones(F.col("nodes"), **o))).first().props]
    assert shown() == [("AB", ["aa", "aa", "cc"]), ("C", ["x"]), ("AB", ["bb"])]
    assert shown(distinct=True)[0] == ("AB", ["aa", "cc"])


def test_listings_and_positions(spark, tmp_path):
    c = _one(spark, "(;SZ[9]AB[aa];W[bb];B[cc];W[])", tmp_path)
    row = c.select("M", "Mc", "Mx", "MI", "MAx", "P1", "P").first()
    assert list(row) == ["1. bb\n2. cc\n3. tt", "1. W\n2. B\n3. W", "1. Wbb\n2. Bcc\n3. Wtt", "1. aa", "1. Baa\n2. Wbb\n3. Bcc\n4. Wtt", "(;SZ[9]AB[aa]AW[bb])", "(;SZ[9]AB[aa][cc]AW[bb])"]
    found = c.where_pattern("(;SZ[9]AB[cc])").select("k", "x").first()
    assert found.k == 2
    with pytest.raises(ValueError, match="where_pattern"):
        c.select("k")
    assert c.turned("vflip").select("M").first() == c.turned(1).select("M").first() and points.symmetry("rot") == points.symmetry("rot90") == 2 and points.symmetry("rot180") == 4


def test_database_answers_from_its_columns(spark, tmp_path):
    c = _one(spark, "(;SZ[9];B[aa];W[ab];B[bb];W[ba];B[cc])", tmp_path)
    writer.write_database(c.games.withColumn("parse_error", F.lit(None).cast("string")), str(tmp_path / "db"))
    db = Collection.of_database(spark, str(tmp_path / "db"))
    want = c.select("m", "Bcapt", "Wcapt", "capt").first()
    assert list(db.select("m", "Bcapt", "Wcapt", "capt").first()) == list(want)
    assert list(db.truncated(keep=2).select("m").first()) == list(c.truncated(keep=2).select("m").first()) == [2]
    plan = db.where("m", "5-").select("fn")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(movect,5)" in plan and "moves" not in plan.split("ReadSchema")[1]
