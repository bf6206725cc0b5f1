"""Validation: each rule adds rows to ``issues``, (path, game_nr, node_nr, severity, rule, message).

Rules over nodes are expressions on a game's nodes; legality comes from the replay. Only
the main line is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .board import with_plays
from .properties import first_value

#: Property classes.
CLASSES = {
    "move": ("B", "W", "BL", "WL", "OB", "OW", "KO", "BM", "DO", "IT", "TE"),
    "setup": ("AB", "AW", "AE", "PL"),
    "root": ("AP", "CA", "FF", "GM", "ST", "SZ"),
    "gameinfo": ("AN", "BR", "BT", "CP", "DT", "EV", "GC", "GN", "HA", "KM", "MN", "ON", "OT", "PB", "PC", "PW", "RE", "RO", "RU", "SO", "TM", "US", "WR", "WT"),
}
POINT = r"^\s*([a-zA-Z]{2}|)\s*$"
AREA = r"^\s*[a-zA-Z]{2}(:[a-zA-Z]{2})?\s*$"
KOMI = r"^\s*[+-]?\d*(\.\d*)?\s*$"
#: Results that are accepted, and spellings of a draw that get a warning.
RESULT = r"^\s*(0|Draw|Jigo|Void|\?|Unfinished|Game suspended.*|Both lost|Not played|[BW]\+(\d*(\.\d*)?|R(esign)?|T(ime)?|F(orfeit)?|bye))\s*$"
ODD_DRAW = r"(?i)^\s*(j|jigo|draw)\s*$"
SINGLE = ("SZ", "HA", "KM", "RE")


def class_of(name: Column) -> Column:
    out = F.lit("other")
    for kind, names in CLASSES.items():
        out = F.when(name.isin(*names), kind).otherwise(out)
    return out


def _issue(severity: str, rule: str, node: Column | int, message: Column | str) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), (F.lit(node) if isinstance(node, int) else node).cast("int").alias("node_nr"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def _if(test: Column, issue: Column) -> Column:
    return F.when(test, F.array(issue)).otherwise(F.array().cast("array<struct<severity:string,rule:string,node_nr:int,message:string>>"))


def result_value(re: Column) -> Column:
    """The score of a result as a signed decimal; null where there is none."""
    n = F.regexp_extract(re, r"^\s*[BW]\+(\d+(?:\.\d+)?)\s*$", 1).try_cast("decimal(9,2)")
    return F.when(re.rlike(r"^\s*(0|Draw|Jigo)\s*$"), F.lit(0).cast("decimal(9,2)")).when(n.isNotNull(), F.when(re.rlike(r"^\s*B"), n).otherwise(-n))


def komi_fits_result(km: Column, re: Column) -> Column:
    """False where komi and result can't both be right: they differ by no integer, and not
    by a quarter that half-counting leaves."""
    k = F.when(km.rlike(KOMI), F.trim(km).try_cast("decimal(9,2)"))
    d = F.abs(F.pmod(k + result_value(re), F.lit(1).cast("decimal(9,2)")))
    quarter = F.pmod(F.abs(k) * 4, F.lit(2).cast("decimal(9,2)")) == 1
    return F.coalesce((d == 0) | quarter, F.lit(True))


def node_issues(skip: frozenset[str] = frozenset()) -> list[tuple[str, Column]]:
    """Rules that look at one node at a time or at the main line's properties."""
    main = F.filter("nodes", lambda n: n["is_main"])
    names = lambda n: F.transform(n["props"], lambda p: p["id"])
    has = lambda n, kind: F.exists(n["props"], lambda p: class_of(p["id"]) == kind)
    per = lambda test, severity, rule, text: F.transform(F.filter(main, test), lambda n: _issue(severity, rule, n["node_id"], text))
    vals = lambda ids: F.flatten(F.transform(main, lambda n: F.flatten(F.transform(F.filter(n["props"], lambda p: p["id"].isin(*ids)), lambda p: F.transform(p["vals"], lambda v: F.struct(n["node_id"].alias("n"), p["id"].alias("id"), v.alias("v")))))))
    bad = lambda ids, pattern, rule: F.transform(F.filter(vals(ids), lambda v: ~v["v"].rlike(pattern)), lambda v: _issue("error", rule, v["n"], F.concat(v["id"], F.lit("["), v["v"], F.lit("]"))))
    km, re, ha, sz = (first_value(F.col("nodes"), x, "root") for x in ("KM", "RE", "HA", "SZ"))
    played = F.filter("moves", lambda m, i: i >= F.col("setup"))
    first, last = F.get(played, F.lit(0)), F.get(played, F.size(played) - 1)
    twice = F.filter(F.transform(played, lambda m, i: F.when((i > 0) & (m["color"] == F.get(played, i - 1)["color"]), i + 1)), lambda i: i.isNotNull())
    n = ha.try_cast("int")
    loser = F.when(re.rlike(r"^B\+R"), "W").when(re.rlike(r"^W\+R"), "B")
    late = F.when(re.rlike(r"^B\+T"), "W").when(re.rlike(r"^W\+T"), "B")
    rules = [
        ("duplicate", per(lambda x: F.size(F.array_distinct(names(x))) < F.size(x["props"]), "error", "duplicate", "a property twice in a node")),
        ("mixed", per(lambda x: has(x, "move") & has(x, "setup"), "error", "mixed", "move and setup properties in a node")),
        ("root_move", per(lambda x: (x["node_id"] == 0) & (F.size(x["props"]) > 1) & F.exists(x["props"], lambda p: p["id"].isin("B", "W")), "warning", "root_move", "a move in the root")),
        ("move_syntax", bad(("B", "W"), POINT, "move_syntax")),
        ("setup_syntax", bad(("AB", "AW", "AE"), AREA, "setup_syntax")),
        ("size", _if(sz.isNotNull() & ~F.coalesce(sz.try_cast("int").between(1, 31), F.lit(False)), _issue("error", "size", 0, F.concat(F.lit("SZ["), sz, F.lit("]"))))),
        ("handicap_syntax", _if(ha.isNotNull() & ~F.coalesce(n.between(0, 25), F.lit(False)), _issue("warning", "handicap_syntax", 0, F.concat(F.lit("HA["), ha, F.lit("]"))))),
        ("handicap", _if(F.coalesce(n, F.lit(0)) != F.when((F.col("awct") == 0) & (F.col("abct") > 0), F.col("abct")).otherwise(F.coalesce(F.when(F.col("awct") > 0, n), F.lit(0))), _issue("warning", "handicap", 0, "handicap and setup stones differ"))),
        ("komi_syntax", _if(km.isNotNull() & ~km.rlike(KOMI), _issue("warning", "komi_syntax", 0, F.concat(F.lit("KM["), km, F.lit("]"))))),
        ("result_syntax", _if(re.isNotNull() & ~re.rlike(RESULT), _issue("error", "result_syntax", 0, F.concat(F.lit("RE["), re, F.lit("]"))).withField("severity", F.when(re.rlike(ODD_DRAW), "warning").otherwise("error")))),
        ("single_value", F.flatten(F.transform(main, lambda x: F.transform(F.filter(x["props"], lambda p: p["id"].isin(*SINGLE) & (F.size(p["vals"]) != 1)), lambda p: _issue("error", "single_value", x["node_id"], F.concat(p["id"], F.lit(" should have a single value"))))))),
        ("komi_result", _if(~komi_fits_result(km, re), _issue("warning", "komi_result", 0, "komi and result don't fit"))),
        ("first_color", _if((first["color"] == "W") & (F.col("abct") == 0), _issue("warning", "first_color", 0, "white plays first"))),
        ("first_color", _if((first["color"] == "B") & (n >= 2), _issue("warning", "first_color", 0, "black plays first after a handicap"))),
        ("same_color", F.transform(twice, lambda i: _issue("warning", "same_color", -1, F.concat(F.lit("move "), i.cast("string"))))),
        ("resign", _if(last["color"] == loser, _issue("warning", "resign", -1, "who resigned moved last"))),
        ("time", _if(last["color"] == late, _issue("warning", "time", -1, "who lost on time moved last"))),
    ]
    return [(name, F.coalesce(found, F.array().cast("array<struct<severity:string,rule:string,node_nr:int,message:string>>"))) for name, found in rules if name not in skip]


def issues(games: DataFrame, skip: frozenset[str] = frozenset()) -> DataFrame:
    """All issues of all games; ``games`` parsed with strict=True also gives grammar issues."""
    shape = "array<struct<severity:string,rule:string,node_nr:int,message:string>>"
    g = with_plays(games)
    grammar = F.transform("issues", lambda i: F.struct(i["severity"].alias("severity"), i["rule"].alias("rule"), F.lit(-1).alias("node_nr"), F.concat(F.lit("line "), i["line"].cast("string"), F.lit(": "), i["message"]).alias("message")))
    broken = _if(F.col("parse_error").isNotNull(), _issue("error", "grammar", -1, F.col("parse_error")))
    illegal = _if(F.col("plays.error").isNotNull(), F.struct(F.lit("error").alias("severity"), F.coalesce("plays.error_rule", F.lit("")).alias("rule"), F.lit(-1).alias("node_nr"), F.col("plays.error").alias("message")))
    cycle = _if(F.col("plays.cycle_move").isNotNull(), _issue("warning", "cycle", -1, F.concat(F.lit("move "), F.col("plays.cycle_move").cast("string"))))
    parts = [x.cast(shape) for x in (grammar, broken, illegal, cycle, *(c for _, c in node_issues(skip)))]
    return g.select("path", "game_nr", F.inline(F.concat(*parts))).select("path", "game_nr", "node_nr", "severity", "rule", "message")


def files_without(files: DataFrame, found: DataFrame) -> DataFrame:
    return files.join(found.select("path"), "path", "left_anti")


def files_with(files: DataFrame, found: DataFrame) -> DataFrame:
    return files.join(found.select("path"), "path", "left_semi")


def exit_code(found: DataFrame) -> int:
    """-1 with errors, 1 with warnings alone, 0 without."""
    worst = {r.severity for r in found.select("severity").distinct().collect()}
    return -1 if "error" in worst else 1 if worst else 0


def assert_count(df: DataFrame, low: int = 1, high: int | None = 1) -> int:
    """0 if the number of rows is in [low, high], -1 if it is lower, 1 if higher; looks at high + 1 rows at most."""
    n = df.limit((high if high is not None else low) + 1).count()
    return -1 if n < low else 1 if high is not None and n > high else 0
