"""Merging records of one game from several collections."""

import pytest
from pyspark.sql import functions as F

from kifulake.operators import merge
from kifulake.sources import sgf, writer

TWENTY = "pd dc dp qp oq jq gq mq ce cn cp ck ci cg bg gc fd fc cc cb dd ec ql po qi".split()


def line(letters):
    return "".join(f";{'BW'[i % 2]}[{m}]" for i, m in enumerate(letters))


def sources(spark, *games):
    rows = [(key, place, sgf.parse(text)[0]["nodes"]) for key, place, text in games]
    return spark.createDataFrame(rows, f"key string, place int, nodes array<{sgf.NODE}>")


def shown(props):
    return ["".join([p.id, *[f"[{v}]" for v in p.vals]]) for p in props]


def test_published_example(spark):
    other = [*TWENTY[:22], "rl", *TWENTY[23:]]
    rows = sources(spark, ("g", 1, f"(;PB[a]PW[b]{line(TWENTY)})"), ("g", 2, f"(;PB[a]DT[1991]{line(other)})"))
    assert merge.merged(rows).first().error == "different moves"
    found = merge.merged(rows, most=1).withColumn("text", writer.text(F.col("nodes"))).first()
    assert found.error is None and found.notes == ["Some sources have B 23 at rl"]
    lines = found.text.split("\n")
    assert lines[:7] == ["(;", "PB[a]", "PW[b]", "DT[1991]", "GC[Some sources have B 23 at rl]", "", line(TWENTY[:10])]
    assert "".join(lines[6:]) == line(TWENTY) + ")" and lines[7] == line(TWENTY[:20])[len(line(TWENTY[:10])) :]


def test_lines_are_made_straight_first(spark):
    text = "(;EV[ The game ]C[root];C[lost]AB[aa];AW[bb][cc]N[x];B[dd]C[gone];TE[1]W[ee](;B[ff]C[end]MN[3])(;B[gg]))"
    g = sources(spark, ("g", 1, text)).select(merge.prepared(F.col("nodes")).alias("g")).first().g
    assert shown(g.head) == ["EV[ The game ]", "C[root]", "AB[aa]", "AW[bb][cc]"]
    assert [(m.color, m.mv) for m in g.moves] == [("B", "dd"), ("W", "ee"), ("B", "ff")] and shown(g.tail) == ["C[end]", "MN[3]"]
    for bare in ("(;)", "(;B[aa])", "(;;;)", "(;C[x];C[y])"):
        g = sources(spark, ("g", 1, bare)).select(merge.prepared(F.col("nodes")).alias("g")).first().g
        assert g.moves == [] and len(g.tail) == bare.count("y")


def test_any_number_of_sources(spark):
    many = sources(
        spark,
        ("g", 3, "(;RE[B+R]AB[bb][aa]PB[x];B[cc];W[dd];B[];C[a])"),
        ("g", 1, "(;RE[B+]PB[x];B[ cc ])"),
        ("g", 2, "(;RE[B+R]PB[y]AB[aa][bb][aa];B[cc];W[ee];B[ff]C[b])"),
        ("g", 4, "(;PB[x];B[cc];W[dd];B[gg];W[tt];B[tt])"),
        ("h", 1, "(;PB[z];B[aa])"), ("h", 2, "(;PB[z];W[aa])"), ("i", 1, "(;PB[q])"), ("j", 5, "(;B[aa];W[tt])"), ("j", 7, "(;;B[tt];W[tt])"),
    )
    got = {r.key: r for r in merge.merged(many, most=9).collect()}
    g = got["g"]
    assert (g.n_sources, shown(g.head)) == (4, ["PB[x]", "RE[B+R]", "PB[y]", "AB[aa][bb]"])
    assert [(m.color, m.mv) for m in g.moves] == [("B", "cc"), ("W", "ee"), ("B", "ff")]
    assert sorted((d.k, d.mv) for d in g.differences) == [(2, "dd"), (3, "gg"), (3, "tt")]
    assert "Some sources have 1 moves" in g.notes and "Some sources have B 3 at gg" in g.notes and g.error is None
    assert got["h"].error == "different colors" and got["h"].nodes is None
    assert got["i"].error is None and got["i"].moves == []
    assert merge.merged(many.where("key = 'g'"), most=2).first().error == "too many differences"
    assert merge.merged(many.limit(0)).collect() == []


def test_many_copies_gather_no_more_than_one(spark):
    text = f"(;PB[a]{line(TWENTY)}C[x])"
    one = sources(spark, ("g", 1, text))
    many = one.withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(3000))))
    a, b = merge.merged(one).first(), merge.merged(many).first()
    assert b.n_sources == 3000 and (a.head, a.moves, a.tail, a.nodes) == (b.head, b.moves, b.tail, b.nodes)


@pytest.mark.parametrize(("text", "options", "error", "tail"), [
    ("(;PB[a];B[aa];W[bb]TR[bb]C[x])", {"triangles": True}, None, ["C[x]"]),
    ("(;PB[a];B[aa];W[bb]TR[cc])", {"triangles": True}, "triangle off the last move", []),
    ("(;PB[a];B[aa];W[bb]TR[cc])", {}, None, ["TR[cc]"]),
    ("(;PB[a]PB[b];B[aa])", {"unique": True}, "duplicate property", []),
    ("(;PB[a]PB[a];B[aa];W[bb]C[x]C[x])", {"unique": True}, None, ["C[x]"]),
    ("(;PB[a];B[aa];W[bb]TR[bb]TR[bb])", {"triangles": True, "unique": True}, None, []),
])
def test_checks(spark, text, options, error, tail):
    r = merge.merged(sources(spark, ("g", 1, text)), **options).first()
    assert (r.error, shown(r.tail)) == (error, tail)
