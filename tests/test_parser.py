from kifulake.sources.sgf import parse

TREE = """(;SZ[7]AB[ab][bb][cb][da][db]AW[ac][bc][cc][dc][ea][eb][ec]PL[W]
C[W kan kill the B group. How?]
(;W[ba]C[Correct])
(;W[aa];B[ba]C[B lives])
(;W[ca];B[ba]C[B lives])
(;W[gg]C[Really?]))"""


def ids(node):
    return [p["id"] for p in node["props"]]


def test_tree_is_flat_with_leaf_intervals():
    (g,) = parse(TREE)
    assert [(n["parent"], n["var_lo"], n["var_hi"], n["is_main"]) for n in g["nodes"]] == [(-1, 1, 4, True), (0, 1, 1, True), (0, 2, 2, False), (2, 2, 2, False), (0, 3, 3, False), (4, 3, 3, False), (0, 4, 4, False)]
    assert (g["size"], g["abct"], g["awct"], g["setup"], len(g["moves"])) == (7, 5, 7, 12, 13)


def test_bom_and_leading_text():
    assert parse(b"\xef\xbb\xbf(;B[aa])")[0]["parse_error"] is None
    assert parse("From: me\n\n(;GN[x];B[aa])")[0]["nodes"][0]["props"][0]["vals"] == ["x"]
    assert ids(parse("(TE[x]B[aa])")[0]["nodes"][0]) == ["TE", "B"]
    strict = parse(b"\xef\xbb\xbf(;B[aa])", strict=True)[0]["issues"]
    assert strict[0]["rule"] == "bom"


def test_bracket_that_does_not_close():
    (g,) = parse("(;C[see [1] 2] 3];B[aa])")
    assert g["nodes"][0]["props"][0]["vals"] == ["see [1]2]3"]
    assert len(g["nodes"]) == 2


def test_escapes_stay():
    assert parse(r"(;C[a\]b\\])")[0]["nodes"][0]["props"][0]["vals"] == [r"a\]b\\"]


def test_names():
    (g,) = parse("(;GaMe[1]File Format[4])")
    assert ids(g["nodes"][0]) == ["GM", "FF"]
    assert ids(parse("(;GaMe[1])", full_ids=True)[0]["nodes"][0]) == ["GaMe"]
    assert "capitals" in parse("(;game[1])")[0]["parse_error"]
    assert "no value" in parse("(;GM;B[aa])")[0]["parse_error"]


def test_variations_without_semicolon_keep_their_nodes():
    (g,) = parse("(;B[aa](W[bb]C[x])())")
    assert ids(g["nodes"][1]) == ["W", "C"] and g["nodes"][1]["var_lo"] == 1


def test_duplicates_and_order_are_kept():
    assert ids(parse("(;C[a]C[b]B[aa])")[0]["nodes"][0]) == ["C", "C", "B"]


def test_several_games():
    assert len(parse("(;B[aa])(;B[bb])")) == 2
    assert len(parse("(;B[aa]) -- (;B[bb])")) == 1
    assert len(parse("(;B[aa]) -- (;B[bb])", many=True)) == 2


def test_broken_texts_give_an_error():
    assert "ends" in parse("(;B[aa")[0]["parse_error"]
    assert parse("nothing")[0]["parse_error"] == "no game found"
    assert parse("") == []


def test_moves_and_passes():
    (g,) = parse("(;SZ[19]AB[aa:ab];B[ dd ];W[];B[tt];W[pass])")
    assert [m["mv"] for m in g["moves"]] == ["aa", "ab", "dd", "tt", "tt", "tt"]
    assert g["setup"] == 2 and g["abct"] == 1


def test_deep_nesting_needs_no_recursion():
    deep = "(;B[aa]" * 3000 + ")" * 3000
    assert len(parse(deep)[0]["nodes"]) == 3000
