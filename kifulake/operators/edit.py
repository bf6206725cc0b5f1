"""Editing records: stripping, transforming, ordering, splitting. All on arrays of nodes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.points import mirrored, symmetry

#: Properties whose values are points, in the first part or in both parts.
POINTED = ("B", "W", "AB", "AW", "AE", "TR", "CR", "MA", "SL", "SQ", "TB", "TW", "DD", "VW", "LB")
LINED = ("AR", "LN")
#: The order of root properties; the rest follow.
ROOT_ORDER = ("FF", "EV", "EVX", "RO", "ID", "PB", "BR", "PW", "WR", "TM", "KM", "RE", "JD", "DT", "DTX", "PC", "BC", "WC", "BT", "WT", "RU", "OH", "HA")
DROPPED = ("GM", "SY", "BS", "WS", "KI")
COMMENTS = ("C", "LB")
STONE_SETS = ("AB", "AW", "AE", "TB", "TW")


def each_props(nodes: Column, change) -> Column:
    """The nodes with change(node, props) as their properties."""
    return F.transform(nodes, lambda n: n.withField("props", change(n, n["props"])))


def prop(name: Column | str, vals: Column) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("id"), vals.alias("vals"))


@dataclass(frozen=True)
class StripRule:
    """Which properties go: all of that name, those whose first value holds a text, or those where it equals it."""

    name: str
    op: str = ""
    value: str = ""

    @classmethod
    def parse(cls, text: str) -> StripRule:
        for i, c in enumerate(text):
            if c in "=:":
                return cls(text[:i], c, text[i + 1 :])
        return cls(text)

    def hits(self, p: Column) -> Column:
        """Of a property of that name."""
        first = F.get(p["vals"], F.lit(0))
        if self.op == ":":
            return F.coalesce(first.contains(self.value), F.lit(False))
        if self.op == "=":
            return F.coalesce(first == self.value, F.lit(False))
        return F.lit(True)


def stripped(nodes: Column, rules: list[StripRule], zone: str = "all", last: Column | None = None) -> Column:
    """Without the properties that a rule hits: the first of its name decides. zone: head (root), middle, tail (last node) or all."""
    last = F.size(nodes) - 1 if last is None else last
    inside = {"all": lambda n: F.lit(True), "head": lambda n: n["node_id"] == 0, "tail": lambda n: n["node_id"] == last, "middle": lambda n: (n["node_id"] > 0) & (n["node_id"] < last)}[zone]

    def hit(p):
        out = F.lit(False)
        for r in reversed(rules):
            out = F.when(p["id"] == r.name, r.hits(p)).otherwise(out)
        return out

    return each_props(nodes, lambda n, ps: F.when(inside(n), F.filter(ps, lambda p: ~hit(p))).otherwise(ps))


def without_empty(nodes: Column) -> Column:
    """Without nodes that have no property (the root stays); node numbers stay as they were."""
    return F.filter(nodes, lambda n: (F.size(n["props"]) > 0) | (n["node_id"] == 0))


def trimmed_values(nodes: Column) -> Column:
    return each_props(nodes, lambda n, ps: F.transform(ps, lambda p: prop(p["id"], F.transform(p["vals"], lambda v: F.btrim(v, F.lit(" \t\r\n"))))))


def without_variations(nodes: Column) -> Column:
    return F.filter(nodes, lambda n: n["is_main"])


def without_comments(nodes: Column) -> Column:
    return each_props(nodes, lambda n, ps: F.filter(ps, lambda p: ~p["id"].isin(*COMMENTS)))


def _mirrored_point(v: Column, t: int, last: Column) -> Column:
    x, y = mirrored(t, F.ascii(v) - 97, F.ascii(F.substring(v, 2, 1)) - 97, last)
    moved = F.concat(F.char(x.cast("int")+97), F.char(y.cast("int") + 97))
    keeps = v.isin("", "tt", "??") | ~v.rlike("^[a-z]{2}$") | (x < 0) | (y < 0)
    return F.when(keeps, v).otherwise(moved)


def _mirrored_value(v: Column, t: int, last: Column, rectangles: bool) -> Column:
    """'aa', 'aa:cc' (both corners, upper left first) or 'aa:text' (a label)."""
    head, tail = F.substring_index(v, ":", 1), F.substring(v, F.length(F.substring_index(v, ":", 1)) + 2, 1 << 30)
    colon = v.contains(":")
    if not rectangles:
        return F.when(colon, F.concat(_mirrored_point(head, t, last), F.lit(":"), tail)).otherwise(_mirrored_point(v, t, last))
    a, b = _mirrored_point(head, t, last), _mirrored_point(tail, t, last)
    first = F.concat(F.least(F.substring(a, 1, 1), F.substring(b, 1, 1)), F.least(F.substring(a, 2, 1), F.substring(b, 2, 1)))
    second = F.concat(F.greatest(F.substring(a, 1, 1), F.substring(b, 1, 1)), F.greatest(F.substring(a, 2, 1), F.substring(b, 2, 1)))
    return F.when(colon, F.concat(first, F.lit(":"), second)).otherwise(_mirrored_point(v, t, last))


def transformed_nodes(nodes: Column, t: int | str, size: Column | int = 19, swap_colors: bool = False) -> Column:
    """All points of all variations under symmetry t; swap: black and white moves and stones change places."""
    last, t = (F.lit(size) if isinstance(size, int) else size) - 1, symmetry(t) if isinstance(t, str) else t

    def one(p):
        name, vals = p["id"], p["vals"]
        labels = F.transform(vals, lambda v: _mirrored_value(v, t, last, False))
        areas = F.transform(vals, lambda v: _mirrored_value(v, t, last, True))
        both = F.transform(vals, lambda v: F.concat(_mirrored_point(F.substring_index(v, ":", 1), t, last), F.lit(":"), _mirrored_point(F.substring_index(v, ":", -1), t, last)))
        new = F.when(name == "LB", labels).when(name.isin(*LINED), both).when(name.isin(*POINTED), areas).otherwise(vals)
        if swap_colors:
            name = F.when(name == "B", "W").when(name == "W", "B").when(name == "AB", "AW").when(name == "AW", "AB").otherwise(name)
        return prop(name, new)

    return each_props(nodes, lambda n, ps: F.transform(ps, one))


def sorted_stones(nodes: Column, distinct: bool = False) -> Column:
    """Stone lists: neighbours of one name merged, values sorted, each once where ``distinct``."""

    def added(done, p):
        last = F.get(F.slice(done, -1, 1), F.lit(0))
        joins = p["id"].isin(*STONE_SETS) & (last["id"] == p["id"])
        longer = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(prop(p["id"], F.concat(last["vals"], p["vals"]))))
        return F.when(joins, longer).otherwise(F.concat(done, F.array(p)))

    def merged(ps):
        joined = F.aggregate(ps, F.slice(ps, 1, 0), added)
        order = lambda vals: F.array_sort(F.array_distinct(vals) if distinct else vals)
        return F.transform(joined, lambda p: prop(p["id"], F.when(p["id"].isin(*STONE_SETS), order(p["vals"])).otherwise(p["vals"])))

    return each_props(nodes, lambda n, ps: F.when(F.size(ps) > 0, merged(ps)).otherwise(ps))


def ordered_root(nodes: Column) -> Column:
    """Root properties in the usual order (the last of equal names counts), then the others;
    some names, and properties without a value, are dropped (but VW)."""
    rank = F.array(*[F.lit(x) for x in ROOT_ORDER])

    def arranged(ps):
        useful = F.filter(ps, lambda p: ~p["id"].isin(*DROPPED) & ((p["id"] == "VW") | F.exists(p["vals"], lambda v: v != "")))
        known = F.flatten(F.transform(rank, lambda r: F.slice(F.reverse(F.filter(useful, lambda p: p["id"] == r)), 1, 1)))
        return F.concat(known, F.filter(useful, lambda p: ~p["id"].isin(*ROOT_ORDER)))

    return each_props(nodes, lambda n, ps: F.when(n["node_id"] == 0, arranged(ps)).otherwise(ps))


def pushed_down(nodes: Column) -> Column:
    """Moves in the root go to a node of their own behind it."""
    root = F.get(nodes, F.lit(0))
    here = F.filter(root["props"], lambda p: p["id"].isin("B", "W"))
    rest = F.filter(root["props"], lambda p: ~p["id"].isin("B", "W"))
    shift = lambda n: n.withField("node_id", n["node_id"] + 1).withField("parent", F.when(n["node_id"] == 0, F.lit(0)).otherwise(n["parent"] + 1))
    moved = F.concat(F.array(root.withField("props", rest)), F.transform(nodes, lambda n: F.when(n["node_id"] == 0, shift(n).withField("props", here)).otherwise(shift(n))))
    return F.when(F.size(here) > 0, moved).otherwise(nodes)


def variations(games: DataFrame) -> DataFrame:
    """A row for each root-to-leaf path: the nodes whose leaves hold it."""
    leaves = games.withColumn("variation", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("nodes", lambda n: n["var_hi"])))))
    return leaves.withColumn("nodes", F.filter("nodes", lambda n: (n["var_lo"] <= F.col("variation")) & (F.col("variation") <= n["var_hi"])))
