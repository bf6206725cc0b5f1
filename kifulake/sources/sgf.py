"""Scanning folders of SGF files into files, games and nodes.

Parsing is the one step that no DataFrame function expresses: a deterministic Arrow UDF
turns a file's bytes into an array of games, and everything after that is expressions on
its fields, so Catalyst drops the parse where no field of it is used and pushes filters
on path, length or time into the scan.

Trees are stored flat, nodes in pre-order. Leaves are numbered from 1; a node holds the
leaves [var_lo, var_hi], so 'is on variation v' is a range test and needs no recursion.
Bytes become text before they are parsed, so that brackets inside the double bytes of East
Asian sets are none: UTF-8 where they are valid as that, else the set that the record states
(CA), else the one they look like.

``typed`` has a column for each thing that a query may ask of a game, each a UDF of its own
over the game's text: what isn't asked for isn't built, and the root alone is read for what
stands there.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROP = "struct<id:string,vals:array<string>>"
NODE = f"struct<node_id:int,parent:int,depth:int,var_lo:int,var_hi:int,is_main:boolean,line:int,props:array<{PROP}>>"
MOVE = "struct<color:string,x:int,y:int,mv:string>"
ISSUE = "struct<severity:string,rule:string,line:int,message:string>"
GAME = f"struct<game_nr:int,size:int,abct:int,awct:int,setup:int,moves:array<{MOVE}>,nodes:array<{NODE}>,parse_error:string,issues:array<{ISSUE}>>"

LINE_END = re.compile("\n")
BOM = "\ufeff"
START = re.compile(r"\(\s*;|\(\s*(?=T[A-Z]?\[)")
CLOSING = re.compile(r"\s*(?:[;()\[A-Za-z]|\Z)")
IDENT = re.compile(r"[A-Za-z\s]+")
BLANKS = re.compile(r"[ \t\r\n\x0b\x0c]*")
#: A value that ends where values end; others are read character by character.
VALUE = re.compile(r"\[([^\]\\]*(?:\\.[^\]\\]*)*)\](?=\s*(?:[;()\[A-Za-z]|\Z))[ \t\r\n\x0b\x0c]*", re.S)
#: Nodes that hold one move and nothing else, in a row; such moves.
PLAIN = re.compile(r"(?:;\s*[BW]\[[a-z]{0,2}\]\s*)+(?=[;()])")
MOVES = re.compile(r";\s*([BW])\[([a-z]{0,2})\]")
#: A root without odd names or brackets; one property of it.
ROOT_NODE = re.compile(r"\s*+\(\s*+;((?:\s*+[A-Z]++(?:\s*+\[[^\]\\]*+(?:\\.[^\]\\]*+)*+\](?=\s*+(?:[;()\[A-Za-z]|\Z)))++)*+)\s*+(?=[;()])", re.S)
PROPERTY = re.compile(r"([A-Z]++)((?:\s*+\[[^\]\\]*+(?:\\.[^\]\\]*+)*+\])++)", re.S)
STONES = {"AB": "B", "AW": "W", "AE": "E"}


class Broken(Exception):
    """The text can't be read further."""


class Enough(Exception):
    """The nodes asked for are read."""


def decoded(data: bytes) -> str:
    """Bytes as text: UTF-8, the stated set, the detected one, or Latin-1, the first that fits."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        from ..functions.charset import ALIASES, SETS, STATED, candidates

    m = STATED.search(data)
    stated = m[1].decode("latin-1").lower() if m else ""
    stated = ALIASES.get(stated, stated)
    for name in [*[x for x in SETS if x.lower() == stated.lower()], *candidates(data)]:
        try:
            return data.decode(SETS[name])
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


class Node:
    """at: where it begins in the text."""

    __slots__ = ("at", "depth", "is_main", "parent", "props", "var_hi", "var_lo")

    def __init__(self, parent: int, depth: int, at: int, is_main: bool, props: list[tuple[str, list[str]]]):
        self.parent, self.depth, self.at, self.is_main, self.props = parent, depth, at, is_main, props
        self.var_lo = self.var_hi = 0


@dataclass
class Game:
    nodes: list[Node] = field(default_factory=list)
    error: str | None = None
    issues: list[tuple[str, str, int, str]] = field(default_factory=list)
    leaves: int = 0


class Reader:
    """Reads the games of one text. strict: report what is tolerated. full_ids: keep
    lower-case letters of property names. many: look for more games behind other text.
    most: read so many nodes of a game alone."""

    def __init__(self, text: str, strict: bool = False, full_ids: bool = False, many: bool = False, most: int | None = None):
        self.text, self.at, self.strict, self.full_ids, self.many, self.most = text, 0, strict, full_ids, many, most
        self.game, self.counted, self.line = Game(), 0, 1

    def line_now(self) -> int:
        self.line += self.text.count("\n", self.counted, self.at)
        self.counted = self.at
        return self.line

    def issue(self, rule: str, message: str, severity: str = "warning") -> None:
        self.game.issues.append((severity, rule, self.line_now(), message))

    def blank(self) -> None:
        self.at = BLANKS.match(self.text, self.at).end()

    def games(self) -> list[Game]:
        out: list[Game] = []
        early: list = []
        if self.text.startswith(BOM):
            self.at = len(BOM)
            if self.strict:
                self.issue("bom", "byte order mark")
                early, self.game = self.game.issues, Game()
        while True:
            self.blank()
            if self.at >= len(self.text):
                break
            m = START.match(self.text, self.at)
            if not m:
                if out and not self.many:
                    break
                m = START.search(self.text, self.at)
                if not m:
                    if not out:
                        self.game.error = "no game found"
                        out.append(self.game)
                    break
                if self.strict:
                    self.issue("grammar", "text before the game", "error")
            self.at = m.start()
            self.game.issues = early + self.game.issues
            try:
                self.tree()
            except Broken as e:
                self.game.error = f"line {self.line_now()}: {e}"
            except Enough:
                return [*out, self.game]
            out.append(self.game)
            failed, early, self.game = self.game.error, [], Game()
            if failed and not self.many:
                break
        if out and early:
            out[0].issues[:0] = early
        return out

    def tree(self) -> None:
        """One game, with a stack of open variations instead of recursion."""
        game, text = self.game, self.text
        # of each open tree: node its first node hangs on, depth, main line?, last node, children, first node, first leaf
        stack: list[list] = []
        while True:
            if self.most is not None and len(game.nodes) > self.most:
                raise Enough
            self.blank()
            if self.at >= len(text):
                raise Broken("the text ends within a game")
            c = text[self.at]
            if c == "(":
                self.at += 1
                self.blank()
                if text[self.at : self.at + 1] == ")":
                    self.at += 1
                    if self.strict:
                        self.issue("grammar", "empty variation")
                    if not stack:
                        return
                    continue
                if stack:
                    top = stack[-1]
                    if top[3] < 0:
                        raise Broken("a variation before the first node")
                    stack.append([top[3], top[1] + 1, top[2] and top[4] == 0, -1, 0, len(game.nodes), game.leaves + 1])
                    top[4] += 1
                else:
                    stack.append([-1, 0, True, -1, 0, 0, 1])
                if text[self.at : self.at + 1] != ";":
                    if self.strict:
                        self.issue("grammar", "a variation without a semicolon")
                    self.node(stack[-1], implied=True)
            elif c == ";":
                if m := PLAIN.match(text, self.at):
                    self.plain(stack[-1], m)
                else:
                    self.at += 1
                    self.node(stack[-1])
            elif c == ")":
                self.at += 1
                top = stack.pop()
                if top[4] == 0:
                    game.leaves += 1
                self.close(top, game)
                if not stack:
                    return
            elif c == "]" or c == "[":
                raise Broken(f"unexpected {c!r}")
            else:
                self.node(stack[-1], implied=True)

    def close(self, top: list, game: Game) -> None:
        """Numbers the leaves under the tree's own nodes."""
        first = top[5]
        node = top[3]
        hi = game.leaves
        lo = top[6]
        while node >= first and node >= 0:
            game.nodes[node].var_lo, game.nodes[node].var_hi = lo, hi
            node = game.nodes[node].parent

    def plain(self, tree: list, run: re.Match) -> None:
        nodes, depth, main = self.game.nodes, tree[1], tree[2]
        at = tree[3] if tree[3] >= 0 else tree[0]
        for m in MOVES.finditer(self.text, run.start(), run.end()):
            nodes.append(Node(at, depth, m.start(), main, [(m[1], [m[2]])]))
            at = len(nodes) - 1
            if self.most is not None and at >= self.most:
                break
        tree[3] = at
        self.at = run.end()

    def node(self, tree: list, implied: bool = False) -> None:
        parent = tree[3] if tree[3] >= 0 else tree[0]
        if implied and tree[3] >= 0 and tree[4] == 0:
            node = self.game.nodes[tree[3]]  # properties that follow a node's own
        else:
            node = Node(parent, tree[1], self.at, tree[2], [])
            self.game.nodes.append(node)
            tree[3] = len(self.game.nodes) - 1
        while True:
            self.blank()
            m = IDENT.match(self.text, self.at)
            if not m or not m[0].strip():
                return
            raw = "".join(m[0].split())
            self.at = m.end()
            name = raw if self.full_ids else "".join(c for c in raw if c.isupper())
            if not name:
                raise Broken(f"a property name without capitals: {raw}")
            if self.strict and name != raw:
                self.issue("grammar", f"lower-case letters in {raw}")
            if self.text[self.at : self.at + 1] != "[":
                raise Broken(f"{name} has no value")
            node.props.append((name, self.values()))

    def values(self) -> list[str]:
        out, text, n = [], self.text, len(self.text)
        while self.at < n and text[self.at] == "[":
            if m := VALUE.match(text, self.at):
                out.append(m[1])
                self.at = m.end()
                continue
            self.at += 1
            parts, start = [], self.at
            while True:
                if self.at >= n:
                    raise Broken("the text ends within a value")
                c = text[self.at]
                if c == "\\":
                    self.at += 2
                elif c == "]":
                    if CLOSING.match(text, self.at + 1):
                        parts.append(text[start : self.at])
                        self.at += 1
                        break
                    if self.strict:
                        self.issue("grammar", "a bracket that isn't escaped", "error")
                    # the bracket is text; white space behind it is lost
                    parts.append(text[start : self.at + 1])
                    self.at += 1
                    self.blank()
                    start = self.at
                else:
                    self.at += 1
            out.append("".join(parts))
            self.blank()
        return out


#: Points by their two letters.
SQUARES = {chr(97 + x) + chr(97 + y): (x, y) for x in range(26) for y in range(26)}


def square(text: str) -> tuple[int, int] | None:
    return SQUARES.get(text)


def area(value: str, size: int = 19) -> list[tuple[int, int]]:
    """The points of 'aa', 'aa:cc' (corners in either order) or 'R6'; none where it can't be read."""
    value = "".join(value.split())
    if (m := re.fullmatch(r"([A-HJ-T])(\d{1,2})", value)) and 1 <= int(m[2]) <= size:
        return [(ord(m[1]) - 65 - (m[1] > "I"), size - int(m[2]))]
    a, colon, b = value.partition(":")
    p, q = square(a), square(b) if colon else square(a)
    if p is None or q is None:
        return []
    return [(x, y) for x in range(min(p[0], q[0]), max(p[0], q[0]) + 1) for y in range(min(p[1], q[1]), max(p[1], q[1]) + 1)]


def board_size(props: list[tuple[str, list[str]]]) -> int:
    for name, vals in props:
        if name == "SZ" and vals and (m := re.match(r"\s*(\d+)", vals[0])):
            return int(m[1]) if int(m[1]) <= 31 else 19
    return 19


def is_pass(value: str, size: int) -> bool:
    return value in ("", "pass") or value == "tt" and size <= 19


def main_line(game: Game, second_node: bool = False) -> tuple:
    """Size, setup counts and moves (setup stones first, by colour and point) of the main line."""
    main = [n for n in game.nodes if n.is_main]
    size = board_size(main[0].props) if main else 19
    head = main[:1]
    if second_node and main and not any(i == "AB" for i, _ in main[0].props):
        head = main[:2]
    setup, counts = set(), {"AB": 0, "AW": 0}
    for name, vals in (p for n in head for p in n.props):
        if name in counts:
            counts[name] += len(vals)
        if name in ("AB", "AW"):
            setup |= {(STONES[name], x, y) for v in vals for x, y in area(v, size)}
    moves = [(c, x, y, chr(97 + x) + chr(97 + y)) for c, x, y in sorted(setup)]
    stones = len(moves)
    known: dict[str, tuple] = {}  # what a value stands for: a game has few
    for n in main:
        for name, vals in n.props:
            if name == "B" or name == "W":
                for v in vals:
                    if v not in known:
                        w = v.strip()
                        at = None if is_pass(w, size) else square(w)
                        known[v] = (*at, w) if at else (None, None, "tt" if is_pass(w, size) else w)
                    moves.append((name, *known[v]))
    return size, counts["AB"], counts["AW"], stones, moves


def parse(data: bytes | str, second_node: bool = False, **options) -> list[dict]:
    """The games of a file, as rows of the GAME schema."""
    names, node_names = ("game_nr", "size", "abct", "awct", "setup", "moves", "nodes", "parse_error", "issues"), ("node_id", "parent", "depth", "var_lo", "var_hi", "is_main", "line", "props")
    out = []
    for row in _rows(data, second_node, **options):
        game = dict(zip(names, row, strict=True))
        game["moves"] = [dict(zip(("color", "x", "y", "mv"), m, strict=True)) for m in game["moves"]]
        game["nodes"] = [dict(zip(node_names, n, strict=True)) for n in game["nodes"]]
        for n in game["nodes"]:
            n["props"] = [{"id": a, "vals": b} for a, b in n["props"]]
        game["issues"] = [dict(zip(("severity", "rule", "line", "message"), x, strict=True)) for x in game["issues"]]
        out.append(game)
    return out


def _rows(data: bytes | str, second_node: bool = False, **options) -> list[tuple]:
    """As parse, in tuples: Arrow takes these much faster than dicts."""
    text = decoded(data) if isinstance(data, bytes) else data
    out = []
    ends = [m.start() for m in LINE_END.finditer(text)]
    for nr, game in enumerate(Reader(text, **options).games(), 1):
        nodes = [(i, n.parent, n.depth, n.var_lo, n.var_hi, n.is_main, bisect_left(ends, n.at) + 1, n.props) for i, n in enumerate(game.nodes)]
        out.append((nr, *main_line(game, second_node), nodes, game.error, game.issues))
    return out


def arrow_type(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(ddl))


def parsed(content: Column, strict: bool = False, full_ids: bool = False, many: bool = False, second_node: bool = False) -> Column:
    """A column of file contents as an array of games."""
    kind = f"array<{GAME}>"
    shape = arrow_type(kind)

    @F.arrow_udf(kind)
    def udf(a: pa.Array) -> pa.Array:
        return pa.array([_rows(x or b"", second_node, strict=strict, full_ids=full_ids, many=many) for x in a.to_pylist()], shape)

    return udf(content)


#: The columns of typed that come of the root alone, and those that a count of moves needs.
ROOT = "struct<size:int,abct:int,awct:int,setup:int>"
ENDS = "struct<movect:int,parse_error:string>"


def _game(data: bytes | None, full_ids: bool, most: int | None = None) -> Game:
    """The one game of a text that split has cut."""
    found = Reader(decoded(data or b""), full_ids=full_ids, most=most).games()
    return found[0] if found else Game(error="no game found")


def _simple(text: str) -> tuple[Game, list[tuple[str, str]]] | None:
    """The root and the moves behind it of a game that is nothing but those, as most are: two
    matches of a pattern. None: other games, which the reader reads."""
    m = ROOT_NODE.match(text)
    run = m and PLAIN.match(text, m.end())
    end = run.end() if run else m.end() if m else 0
    if not m or text[end:].strip() != ")":
        return None
    root = Node(-1, 0, 0, True, [(p[1], [v[1] for v in VALUE.finditer(p[2])]) for p in PROPERTY.finditer(m[1])])
    return Game([root]), MOVES.findall(run[0]) if run else []


#: A plain move as a row of MOVE, on boards of 19 lines and less, and on larger ones.
_POINTS: tuple[dict, dict] = ({}, {})


def _line(data: bytes | None, full_ids: bool, second_node: bool) -> tuple:
    """main_line of the game of a text."""
    text = decoded(data or b"")
    found = None if full_ids or second_node else _simple(text)
    if found is None:
        return main_line(_game(data, full_ids), second_node)
    size, black, white, setup, moves = main_line(found[0])
    known = _POINTS[size > 19]
    for color, value in set(found[1]).difference(known):
        at = None if is_pass(value, size) else square(value)
        known[color, value] = (color, *at, value) if at else (color, None, None, "tt" if is_pass(value, size) else value)
    moves += map(known.__getitem__, found[1])
    return size, black, white, setup, moves


def _root(data: bytes | None, full_ids: bool) -> Game:
    """A game's root alone."""
    m = None if full_ids else ROOT_NODE.match(decoded(data or b""))
    if m is None:
        return _game(data, full_ids, 0)
    return Game([Node(-1, 0, 0, True, [(p[1], [v[1] for v in VALUE.finditer(p[2])]) for p in PROPERTY.finditer(m[1])])])


def _lists(flat: list[pa.Array], names: list[str], sizes: list[int]) -> pa.ListArray:
    """Lists of structs from the columns of all their elements in a row."""
    cuts = pa.array([0, *accumulate(sizes)], pa.int32())
    return pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays(flat, names=names) if len(names) > 1 else flat[0])


def moves_array(games_: list[list[tuple]]) -> pa.Array:
    """Lists of (color, x, y, mv) as Arrow lists, built column by column."""
    every = [m for moves in games_ for m in moves]
    columns = list(zip(*every, strict=True)) or [()] * 4
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
    return _lists([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["color", "x", "y", "mv"], [len(m) for m in games_])


def nodes_array(games_: list[Game]) -> pa.Array:
    """The nodes of games as Arrow lists, built column by column."""
    every = [n for g in games_ for n in g.nodes]
    props = [p for n in every for p in n.props]
    vals = _lists([pa.array([v for _, vs in props for v in vs], pa.string())], ["vals"], [len(vs) for _, vs in props])
    held = _lists([pa.array([i for i, _ in props], pa.string()), vals], ["id", "vals"], [len(n.props) for n in every])
    number = lambda values: pa.array(values, pa.int32())
    columns = [number([i for g in games_ for i in range(len(g.nodes))]), *(number([getattr(n, a) for n in every]) for a in ("parent", "depth", "var_lo", "var_hi")), pa.array([n.is_main for n in every], pa.bool_()), number([n.at for n in every]), held]
    return _lists(columns, ["node_id", "parent", "depth", "var_lo", "var_hi", "is_main", "line", "props"], [len(g.nodes) for g in games_])


def typed(texts: DataFrame, full_ids: bool = False, second_node: bool = False) -> DataFrame:
    """The games of split.texts with the fields of GAME, and movect, each column by itself."""
    shapes = {k: arrow_type(k) for k in (ROOT, ENDS)}

    @F.arrow_udf(ROOT)
    def root(a: pa.Array) -> pa.Array:
        found = [main_line(_game(x, full_ids, 1) if second_node else _root(x, full_ids), second_node) for x in a.to_pylist()]
        return pa.array([(s, b, w, n) for s, b, w, n, _ in found], shapes[ROOT])

    @F.arrow_udf(ENDS)
    def ends(a: pa.Array) -> pa.Array:
        out = []
        for x in a.to_pylist():
            simple = None if full_ids else _simple(decoded(x or b""))
            g, n = (simple[0], len(simple[1])) if simple else (_game(x, full_ids), 0)
            out.append((n + sum(len(v) for n in g.nodes if n.is_main for i, v in n.props if i in ("B", "W")), g.error))
        return pa.array(out, shapes[ENDS])

    @F.arrow_udf(f"array<{MOVE}>")
    def moves(a: pa.Array) -> pa.Array:
        return moves_array([_line(x, full_ids, second_node)[4] for x in a.to_pylist()])

    @F.arrow_udf(f"array<{NODE}>")
    def nodes_(a: pa.Array) -> pa.Array:
        found = [_game(x, full_ids) for x in a.to_pylist()]
        for x, g in zip(a.to_pylist(), found, strict=True):
            lines = [m.start() for m in LINE_END.finditer(decoded(x or b""))]
            for n in g.nodes:
                n.at = bisect_left(lines, n.at) + 1
        return nodes_array(found)

    out = texts.withColumns({"_root": root("text"), "_ends": ends("text"), "moves": moves("text"), "nodes": nodes_("text")})
    issues = F.array().cast(f"array<{ISSUE}>")  # of the strict parser alone
    return out.select("path", "n_games", "game_nr", "_root.*", "_ends.movect", "moves", "nodes", "_ends.parse_error", issues.alias("issues"), F.concat_ws("#", "path", F.col("game_nr").cast("string")).alias("game_id"), "text")


def first_value(text: Column, name: str, where: str = "all", full_ids: bool = False) -> Column:
    """As properties.first_value, of a game's text: no node is handed on but the value."""

    @F.arrow_udf("string")
    def udf(a: pa.Array) -> pa.Array:
        out = []
        for x in a.to_pylist():
            simple = None if full_ids or name in ("B", "W") else _simple(decoded(x or b""))
            nodes_ = simple[0].nodes if simple else _root(x, full_ids).nodes if where == "root" else _game(x, full_ids).nodes
            some = {"all": nodes_, "root": nodes_[:1], "rest": nodes_[1:]}[where]
            out.append(next((vals[0] if vals else None for n in some for i, vals in n.props if i == name), None))
        return pa.array(out, pa.string())

    return udf(text)


def scan(spark: SparkSession, paths: str | list[str], recursive: bool = False, extension: str = ".sgf") -> DataFrame:
    """files(path, modificationTime, length, content); an empty extension takes all files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if extension:
        reader = reader.option("pathGlobFilter", f"*{extension}")
    return reader.load(paths)


def games(files: DataFrame, **options) -> DataFrame:
    """A row for each game of each file, the fields of GAME beside path and n_games."""
    every = files.select("path", parsed(F.col("content"), **options).alias("games"))
    # explode_outer: a plain explode would make Catalyst infer a filter on the UDF, and parse twice
    rows = every.select("path", F.size("games").alias("n_games"), F.explode_outer("games").alias("g")).where("g is not null")
    return rows.select("path", "n_games", "g.*").withColumn("game_id", F.concat_ws("#", "path", F.col("game_nr").cast("string")))


def nodes(games_: DataFrame) -> DataFrame:
    """A row for each node: path, game_nr, the fields of NODE."""
    return games_.select("path", "game_nr", F.explode("nodes").alias("n")).select("path", "game_nr", "n.*")
