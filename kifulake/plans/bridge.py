"""Queries over the driver's tables, with their SQL twins.

``events`` is read as games: one for each user, moves in the order of (ts, event_id). The
operators are those of this package, applied to move arrays and property lists built from
the tables; the SQL says the same over rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize
from ..functions.points import swapped, transformed
from ..functions.predicates import Interval, conjunction, string_test
from ..operators import bitmap, board, check, chunks, compare, edit, merge, moves, pattern, properties, repeats, signatures
from ..session import table
from ..sources import split
from .collection import Collection

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function under its name, with its SQL twin if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- games from events


def move_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "ts")
    x, y = F.col("event_id") % 19, F.floor(F.col("event_id") / 19) % 19
    passed = F.col("event_id") % 97 == 0
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = e.select(F.col("user_id").alias("game_id"), k.cast("long").alias("k"), passed.alias("is_pass"), x.alias("x"), y.alias("y"))
    mv = F.when(F.col("is_pass"), "tt").otherwise(F.concat(F.char((F.col("x") + 97).cast("int")), F.char((F.col("y") + 97).cast("int"))))
    return rows.withColumns({"color": F.when(F.col("k") % 2 == 1, "B").otherwise("W"), "mv": mv})


def games(spark: SparkSession, sf: str) -> DataFrame:
    """game_id and its moves as an array, as the parser gives them. One shuffle; nothing
    after it needs another, as all signatures and listings are expressions on the array."""
    e = table(spark, sf, "events").select("user_id", "event_id", "ts")
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id")))

    def one(s, i):
        x, y = (s["event_id"] % 19).cast("int"), (F.floor(s["event_id"] / 19) % 19).cast("int")
        passed = s["event_id"] % 97 == 0
        mv = F.when(passed, "tt").otherwise(F.concat(F.char(x + 97), F.char(y + 97)))
        return F.struct(F.when(i % 2 == 0, "B").otherwise("W").alias("color"), F.when(~passed, x).alias("x"), F.when(~passed, y).alias("y"), mv.alias("mv"))

    return e.groupBy(F.col("user_id").alias("game_id")).agg(ordered.alias("o")).select("game_id", F.transform("o", one).alias("moves"))


MOVES = """m0 as (select user_id as game_id, row_number() over (partition by user_id order by ts, event_id) as k,
 case when event_id % 97 = 0 then 1 else 0 end as is_pass, event_id % 19 as x, cast(floor(event_id / 19.0) as bigint) % 19 as y from events),
moves as (select *, case when k % 2 = 1 then 'B' else 'W' end as color,
 case when is_pass = 1 then 'tt' else chr(cast(97 + x as int)) || chr(cast(97 + y as int)) end as mv from m0)"""
EIGHT = ("x", "y"), ("x", "18-y"), ("y", "18-x"), ("y", "x"), ("18-x", "18-y"), ("18-x", "y"), ("18-y", "x"), ("18-y", "18-x")
#: Each move under each symmetry t.
SYM = MOVES + ", sym as (" + " union all ".join(f"select game_id, k, {t} as t, case when is_pass = 1 then 'tt' else chr(cast(97 + {a} as int)) || chr(cast(97 + {b} as int)) end as mv from moves" for t, (a, b) in enumerate(EIGHT)) + ")"
PAIRS = MOVES + """, a as (select game_id as pair, k, mv, x, y, is_pass from moves), b as (select game_id - 1 as pair, k, mv, x, y, is_pass from moves),
ids as (select distinct a.pair from a join b on a.pair = b.pair)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each game with the next user's, as move arrays a and b."""
    g = games(spark, sf)
    return g.select(F.col("game_id").alias("pair"), F.col("moves").alias("a")).join(g.select((F.col("game_id") - 1).alias("pair"), F.col("moves").alias("b")), "pair")


def big(c: Column | str, name: str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long").alias(name)


# ---------------------------------------------------------------- selection


@query("select user_id as game_id, count(*) as n from events group by user_id")
def scan_count_per_group(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("game_id")).agg(F.count("*").alias("n"))


@query(f"with {MOVES} select game_id, count(*) as movect, cast(sum(case when color = 'B' then 1 else 0 end) as bigint) as black, cast(sum(is_pass) as bigint) as passes from moves group by game_id")
def report_ints(spark, sf):
    count = lambda f: F.size(F.filter("moves", f))
    return games(spark, sf).select("game_id", big(F.size("moves"), "movect"), big(count(lambda m: m["color"] == "B"), "black"), big(count(lambda m: m["mv"] == "tt"), "passes"))


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity >= 10 and l_quantity <= 12 and l_linenumber >= 3")
def filter_interval(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.where(conjunction([Interval.parse("10-12").test(li["l_quantity"]), Interval.parse("3-").test(li["l_linenumber"])])).select("l_orderkey", "l_linenumber", "l_quantity")


@query("select o_orderkey, o_custkey from orders where o_orderstatus = 'P'")
def filter_eq(spark, sf):
    o = table(spark, sf, "orders")
    return o.where(string_test(o["o_orderstatus"], "=", "P")).select("o_orderkey", "o_custkey")


@query("select doc_id, source from documents where contains(text, 'thou')")
def filter_contains(spark, sf):
    d = table(spark, sf, "documents")
    return d.where(string_test(d["text"], ":", "thou")).select("doc_id", "source")


@query("select o_orderkey from orders left join (select distinct l_orderkey from lineitem where l_returnflag = 'R') on o_orderkey = l_orderkey where l_orderkey is null")
def filter_absent(spark, sf):
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey").distinct()
    o = table(spark, sf, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.where(string_test(o["l_orderkey"], "!")).select("o_orderkey")


@query("select o_orderkey from orders where case when o_orderpriority = '1-URGENT' then null else o_orderpriority end <> '5-LOW'")
def filter_not_eq_null(spark, sf):
    o = table(spark, sf, "orders").withColumn("p", F.expr("nullif(o_orderpriority, '1-URGENT')"))
    return o.where(string_test(o["p"], "!=", "5-LOW")).select("o_orderkey")


@query("select o_orderkey from orders where case when o_orderpriority = '1-URGENT' then null else o_orderpriority end not like '%I%'")
def filter_not_contains_null(spark, sf):
    o = table(spark, sf, "orders").withColumn("p", F.expr("nullif(o_orderpriority, '1-URGENT')"))
    return o.where(string_test(o["p"], "!:", "I")).select("o_orderkey")


@query("select p_partkey, p_name from part where p_size between 5 and 9 and p_brand = 'Brand#13' and p_type <> 'STANDARD'")
def filter_and(spark, sf):
    p = table(spark, sf, "part")
    return p.where(conjunction([Interval.parse("5-9").test(p["p_size"]), string_test(p["p_brand"], "=", "Brand#13"), string_test(p["p_type"], "!=", "STANDARD")])).select("p_partkey", "p_name")


@query("select doc_id, source from documents where contains(source, 'src1')")
def filter_filename(spark, sf):
    d = table(spark, sf, "documents")
    return d.where(string_test(d["source"], ":", "src1")).select("doc_id", "source")


# ---------------------------------------------------------------- properties: a game is an order, its nodes are lines


def order_nodes(spark, sf) -> DataFrame:
    """Orders as records: node k holds RF, LS and SH (two values on odd lines) of line k."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey")
    sh = F.when(F.col("l_linenumber") % 2 == 1, F.array(F.col("l_returnflag"), F.col("l_linestatus"))).otherwise(F.array("l_linestatus"))
    props = F.array(edit.prop("RF", F.array("l_returnflag")), edit.prop("SH", sh))
    node = F.struct(F.col("l_linenumber").cast("int").alias("n"), F.col("l_suppkey").alias("s"), (F.col("l_linenumber") - 1).cast("int").alias("node_id"), props.alias("props"))
    return li.groupBy(F.col("l_orderkey").alias("game_id")).agg(F.array_sort(F.collect_list(node)).alias("nodes"))


LINES = "l as (select l_orderkey as game_id, l_linenumber as n, l_suppkey as s, l_returnflag as rf, l_linestatus as ls from lineitem)"
#: The first line of each game among those that a condition leaves.
FIRST = LINES + ", f as (select *, row_number() over (partition by game_id order by n, s, rf, ls) as r from l where {})"


@query(f"with {FIRST.format(True)} select game_id, rf from f where r = 1")
def prop_first_value(spark, sf):
    return order_nodes(spark, sf).select("game_id", properties.first_value(F.col("nodes"), "RF").alias("rf"))


@query(f"with {LINES} select game_id, string_agg('RF SH', ' ' order by n) as ids from l group by game_id")
def prop_all_ids(spark, sf):
    return order_nodes(spark, sf).select("game_id", properties.ids(F.col("nodes")).alias("ids"))


@query(f"with {LINES} select game_id, coalesce(string_agg(case when n % 2 = 1 then 'SH-2' end, ' ' order by n), '') as ids from l group by game_id")
def prop_multi(spark, sf):
    return order_nodes(spark, sf).select("game_id", properties.multi_ids(F.col("nodes")).alias("ids"))


@query(f"with {FIRST.format(True)} select game_id, 'SH[' || case when n % 2 = 1 then rf || '][' else '' end || ls || ']' as sh from f where r = 1")
def prop_first_all(spark, sf):
    return order_nodes(spark, sf).select("game_id", properties.first_all(F.col("nodes"), "SH").alias("sh"))


@query(f"with {FIRST.format('n > 1')} select game_id, rf from f where r = 1")
def prop_not_root(spark, sf):
    found = order_nodes(spark, sf).select("game_id", properties.first_value(F.col("nodes"), "RF", "rest").alias("rf"))
    return found.where("rf is not null")


@query(f"with {FIRST.format('n = 1')} select game_id, rf from f where r = 1")
def prop_root(spark, sf):
    return order_nodes(spark, sf).select("game_id", properties.first_value(F.col("nodes"), "RF", "root").alias("rf")).where("rf is not null")


RESULTS = f"g as (select o_orderkey as game_id, case o_orderstatus when 'F' then 'B+' || cast(o_orderkey % 40 as varchar) when 'O' then 'W+' || cast(o_orderkey % 40 as varchar) else '0' end as re, o_orderpriority as pb, case when o_custkey % 7 = 0 then null else cast(o_custkey as varchar) end as pw from orders)"


def results(spark, sf) -> DataFrame:
    n = (F.col("o_orderkey") % 40).cast("string")
    re = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("B+"), n)).when(F.col("o_orderstatus") == "O", F.concat(F.lit("W+"), n)).otherwise("0")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("game_id"), re.alias("re"), F.col("o_orderpriority").alias("pb"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey").cast("string")).alias("pw"))


@query(f"with {RESULTS} select game_id, case when re like 'B+%' then pb when re like 'W+%' then pw end as winner, case when re like 'B+%' then pw when re like 'W+%' then pb end as loser from g")
def winner_loser(spark, sf):
    c = [F.col(x) for x in ("re", "pb", "pw")]
    return results(spark, sf).select("game_id", properties.winner(*c).alias("winner"), properties.loser(*c).alias("loser"))


@query(f"with {RESULTS} select game_id, pb || ',' || pw as player from g where contains(pb || ',' || pw, 'H,12')")
def player_contains(spark, sf):
    return results(spark, sf).withColumn("player", properties.players(F.col("pb"), F.col("pw"))).where(string_test(F.col("player"), ":", "H,12")).select("game_id", "player")


# ---------------------------------------------------------------- moves


@query(f"with {MOVES}, p as (select unnest([3, 20, 59, 60]) as k), g as (select distinct game_id from moves) select g.game_id, string_agg(coalesce(mv, '??'), ' ' order by p.k) as mv from g cross join p left join moves m on m.game_id = g.game_id and m.k = p.k group by g.game_id")
def moves_at_positions(spark, sf):
    return games(spark, sf).select("game_id", F.array_join(moves.listed(F.col("moves"), "3,20,59-60"), " ").alias("mv"))


@query(f"with {MOVES} select game_id, string_agg(cast(k as varchar) || '. ' || color || '[' || mv || ']', ' ' order by k) as mv from moves group by game_id")
def moves_numbered(spark, sf):
    return games(spark, sf).select("game_id", F.array_join(moves.listed(F.col("moves"), numbered=True, colored=True), " ").alias("mv"))


@query(f"with {MOVES} select game_id, string_agg(mv, '' order by k) as mv from moves group by game_id")
def move_string(spark, sf):
    return games(spark, sf).select("game_id", signatures.joined(F.col("moves")).alias("mv"))


@query(f"with {MOVES} select game_id, string_agg(mv, '' order by k) as mv from moves where k <= 10 group by game_id")
def truncate_head(spark, sf):
    return games(spark, sf).select("game_id", signatures.joined(moves.truncated(F.col("moves"), keep=10)).alias("mv"))


@query(f"with {MOVES}, n as (select game_id as g, count(*) as n from moves group by game_id) select game_id, string_agg(mv, '' order by k) as mv from moves join n on g = game_id where k <= n - 40 group by game_id")
def truncate_tail(spark, sf):
    return games(spark, sf).select("game_id", signatures.joined(moves.truncated(F.col("moves"), drop=40)).alias("mv")).where("mv <> ''")


@query(f"with {MOVES}, n as (select game_id as g, max(case when is_pass = 0 then k end) as n from moves group by game_id) select game_id, count(*) as left_moves from moves join n on g = game_id where k <= n group by game_id")
def strip_trailing_pass(spark, sf):
    return games(spark, sf).select("game_id", big(F.size(moves.without_trailing_passes(F.col("moves"))), "left_moves"))


@query(f"with {MOVES} select distinct game_id from moves where mv = 'dd' and game_id in (select game_id from moves where mv = 'cf')")
def pos_played(spark, sf):
    return games(spark, sf).where(moves.played(F.col("moves"), moves.positions("dd,C14"))).select("game_id")


@query(f"with {MOVES} select distinct game_id from moves where mv = 'qd' and k between 1 and 40")
def pos_played_range(spark, sf):
    return games(spark, sf).where(moves.played(F.col("moves"), moves.positions("qd:1-40"))).select("game_id")


@query(f"with {MOVES} select distinct game_id from moves where mv = 'pp' and color = 'W'")
def pos_played_color(spark, sf):
    return games(spark, sf).where(moves.played(F.col("moves"), moves.positions("pp", color="W"))).select("game_id")


@query(f"with {MOVES} select distinct a.game_id from moves a join moves b on a.game_id = b.game_id where a.mv = 'dd' and b.mv = 'qd' and b.color = 'B'")
def pos_played_bits(spark, sf):
    """By the points' bits alone, as the database answers it."""
    black, white = (bitmap.point_words(F.col("moves"), c) for c in "BW")
    bits, rest = moves.played_bits(black, white, [*moves.positions("dd"), *moves.positions("qd", "B")])
    return games(spark, sf).where(bits & moves.played(F.col("moves"), rest)).select("game_id")


TWO_STONES = "(;SZ[19]AB[cd]AW[qf])"


@query("with " + MOVES + ", marks as (select distinct game_id, color, x, y from moves where is_pass = 0), want as (" + " union all ".join(
    f"select {t} as t, {s} as s, '{b}' as black, '{w}' as white, {a} as x, {c} as y, {d} as u, {e} as v" for t, ((a, c), (d, e)) in enumerate(zip(((2, 3), (2, 15), (3, 16), (3, 2), (16, 15), (16, 3), (15, 2), (15, 16)), ((16, 5), (16, 13), (5, 2), (5, 16), (2, 13), (2, 5), (13, 16), (13, 2)), strict=True)) for s, b, w in ((0, "B", "W"), (1, "W", "B"))
) + ") select distinct p.game_id from want join marks p on p.color = black and p.x = want.x and p.y = want.y join marks q on q.game_id = p.game_id and q.color = white and q.x = u and q.y = v")
def pattern_bits(spark, sf):
    """Games that some of a pattern's 16 variants can match, before any move is a row."""
    size, wanted = pattern.constraints(TWO_STONES)
    black, white = (bitmap.point_words(F.col("moves"), c) for c in "BW")
    return games(spark, sf).where(bitmap.may_match(black, white, pattern.variants(wanted, size - 1, True, True))).select("game_id")


@query(f"""with {MOVES}, marks as (select *, lag(color) over (partition by game_id, x, y order by k) as before from moves where is_pass = 0),
boards as (select m.game_id, m.k, string_agg(s.x || ',' || s.y || s.color, ' ' order by s.x, s.y) as board from marks m join
  (select game_id, k, x, y, color, lead(k, 1, 1000000000) over (partition by game_id, x, y order by k) as until from marks) s on s.game_id = m.game_id and s.k <= m.k and s.until > m.k group by m.game_id, m.k)
select game_id, k as move_nr from (select *, row_number() over (partition by game_id, board order by k) as n from boards) where n > 1""")
def repeated_positions(spark, sf):
    """Moves after which the board is as it was before; a stone takes the place of the one it is set on."""
    w = Window.partitionBy("game_id", "x", "y").orderBy("k")
    events = move_rows(spark, sf).where("not is_pass").withColumn("replaces", F.lag("color").over(w)).withColumn("move_nr", F.col("k"))
    return repeats.repeated(events, order="k")


@query(f"""with {PAIRS}, joined as (select coalesce(a.pair, b.pair) as pair, coalesce(a.k, b.k) as k, coalesce(a.mv, b.mv) as mv, a.mv as m1, b.mv as m2 from a full join b on a.pair = b.pair and a.k = b.k where coalesce(a.pair, b.pair) in (select pair from ids)),
ends as (select pair, greatest(count(m1), coalesce(max(k) filter (mv <> 'tt'), 0)) as n, count(m1) as n1, count(m2) as n2 from joined group by pair)
select b.pair, max(n) as movect, md5(string_agg(mv, '' order by k) || chr(10)) as sig, count(*) filter (m1 <> m2) as differences,
 coalesce(string_agg(case when m1 <> m2 then 'Some sources have ' || case when k % 2 = 1 then 'B' else 'W' end || ' ' || k || ' at ' || m2 end, '.' || chr(10) order by k), '')
 || case when max(n1) <> max(n2) and max(n) > least(max(n1), max(n2)) and bool_or(k > least(n1, n2) and mv <> 'tt')
  then case when count(*) filter (m1 <> m2) > 0 then '.' || chr(10) else '' end || 'Some sources have ' || least(max(n1), max(n2)) || ' moves' else '' end as notes
from joined b join ends e on e.pair = b.pair and b.k <= e.n group by b.pair""")
def merge_collections(spark, sf):
    """Each game merged with the next user's, however many moves differ, with the notes that this gives."""
    node = lambda m: F.struct(F.lit(True).alias("is_main"), F.array(F.struct(m["color"].alias("id"), F.array(m["mv"]).alias("vals"))).alias("props"))
    root = F.array(F.struct(F.lit(True).alias("is_main"), F.array().cast("array<struct<id:string,vals:array<string>>>").alias("props")))
    both = pairs(spark, sf).select("pair", F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.concat(root, F.transform(c, node)).alias("nodes")) for i, c in enumerate("ab")])).alias("s")).select("pair", "s.*")
    found = merge.merged(both, "pair", most=1000)
    return found.select("pair", big(F.size("moves"), "movect"), F.md5(F.concat(F.array_join(F.transform("moves", lambda m: m["mv"]), ""), F.lit("\n")).cast("binary")).alias("sig"), big(F.size("differences"), "differences"), compare.joined_notes(F.col("notes")).alias("notes"))


# ---------------------------------------------------------------- signatures and symmetries


@query(f"with {MOVES} select game_id, md5(string_agg(mv, '' order by k) || chr(10)) as sig from moves group by game_id")
def sig_md5(spark, sf):
    return games(spark, sf).select("game_id", signatures.md5(F.col("moves")).alias("sig"))


CANON = SYM + ", s as (select game_id, t, md5(string_agg(mv, '' order by k) || chr(10)) as sig from sym group by game_id, t)"


@query(f"with {CANON} select game_id, min(sig) as sig from s group by game_id")
def sig_canonical(spark, sf):
    return games(spark, sf).select("game_id", signatures.canonical(F.col("moves")).alias("sig"))


@query(f"with {CANON} select game_id, min(sig || '-' || cast(t as varchar)) as sig from s group by game_id")
def sig_canonical_ext(spark, sf):
    return games(spark, sf).select("game_id", signatures.canonical(F.col("moves"), extended=True).alias("sig"))


def _dyer_sql(positions: str, t: bool = False) -> str:
    source = SYM if t else MOVES
    g = "select distinct game_id, t from sym" if t else "select distinct game_id, 0 as t from moves"
    on = "m.game_id = g.game_id and m.k = p.k" + (" and m.t = g.t" if t else "")
    inner = f"select g.game_id, g.t, string_agg(coalesce(mv, '??'), '' order by p.k) as sig from g cross join p left join {'sym' if t else 'moves'} m on {on} group by g.game_id, g.t"
    return f"with {source}, p as (select unnest([{positions}]) as k), g as ({g}), d as ({inner}) select game_id, min(sig) as sig from d group by game_id"


@query(_dyer_sql("20, 40, 60"))
def sig_dyer_a(spark, sf):
    return games(spark, sf).select("game_id", signatures.dyer(F.col("moves"), "A").alias("sig"))


@query(_dyer_sql("31, 51, 71"))
def sig_dyer_b(spark, sf):
    return games(spark, sf).select("game_id", signatures.dyer(F.col("moves"), "B").alias("sig"))


@query(_dyer_sql("20, 40, 60, 31, 51, 71").replace("order by p.k", "order by case when p.k in (20, 40, 60) then 0 else 1 end, p.k"))
def sig_dyer_c(spark, sf):
    return games(spark, sf).select("game_id", signatures.dyer(F.col("moves"), "C").alias("sig"))


@query(_dyer_sql("20, 40, 60", True))
def sig_dyer_norm(spark, sf):
    return games(spark, sf).select("game_id", signatures.dyer_normalised(F.col("moves"), "A").alias("sig"))


@query(f"with {SYM} select game_id, cast(t as bigint) as t, string_agg(mv, '' order by k) as mv from sym group by game_id, t")
def transform_8(spark, sf):
    g = games(spark, sf).select("game_id", F.col("moves").alias("m"))
    each = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), signatures.joined(F.col("m"), t).alias("mv")) for t in range(8)])
    return g.select("game_id", F.inline(each))


@query(f"with {SYM} select game_id, k, mv from sym where t = 5")
def transform_point(spark, sf):
    g = games(spark, sf).select("game_id", F.posexplode("moves").alias("i", "m"))
    return g.select("game_id", big(F.col("i") + 1, "k"), transformed(F.col("m"), 5).alias("mv"))


@query(f"with {MOVES} select game_id, string_agg((case when color = 'B' then 'W' else 'B' end) || mv, ' ' order by k) as mv from moves group by game_id")
def swap_colors(spark, sf):
    return games(spark, sf).select("game_id", F.array_join(F.transform(moves.colors_swapped(F.col("moves")), lambda m: F.concat(m["color"], m["mv"])), " ").alias("mv"))


@query(f"with {MOVES}, s as (select game_id, md5(string_agg(mv, '' order by k) || chr(10)) as sig from moves group by game_id) select sig, min(game_id) as game_id, count(*) as copies from s group by sig")
def dedupe_by_signature(spark, sf):
    g = games(spark, sf).select("game_id", signatures.md5(F.col("moves")).alias("sig"))
    return g.groupBy("sig").agg(F.min("game_id").alias("game_id"), F.count("*").alias("copies"))


# ---------------------------------------------------------------- semi and anti joins


@query(f"with {MOVES}, s as (select game_id, count(*) as n from moves group by game_id) select game_id, n as movect from s where n = (select n from s where game_id = (select min(game_id) from s))")
def ref_semi_join(spark, sf):
    all_games = Collection(games(spark, sf).withColumn("setup", F.lit(0)))
    reference = Collection(all_games.games.orderBy("game_id").limit(1))  # the reference record
    return all_games.like(reference, "m").games.select("game_id", big(F.size("moves"), "movect"))


@query(f"with {MOVES}, n as (select game_id, count(*) as movect, bool_or(mv = 'cd') as wanted from moves group by game_id) select game_id, movect from n where movect in (select movect from n where wanted)")
def ref_many_semi_join(spark, sf):
    """Games as long as some game of a reference of many."""
    every = Collection(games(spark, sf).withColumn("setup", F.lit(0)))
    return every.like(every.where_played("cd"), "m", every=True).games.select("game_id", big(F.size("moves"), "movect"))


@query(f"with {MOVES} select game_id, count(*) as movect, md5(string_agg(mv, '' order by k) || chr(10)) as sig from moves group by game_id")
def scan_in_parts(spark, sf):
    """Games written as collections and read back, as large files are: in parts, cut by their brackets."""
    to = f"{split.shared_folder(spark)}/collections-{uuid.uuid4().hex}"
    games(spark, sf).select(F.concat(F.lit("(;SZ[19]GN["), F.col("game_id").cast("string"), F.lit("]"), F.array_join(F.transform("moves", lambda m: F.concat(F.lit(";"), m["color"], F.lit("["), m["mv"], F.lit("]"))), ""), F.lit(")")).alias("value")).write.text(to)
    found = Collection.of_files(spark, to, extension="", large=1)
    return found.select("propGN", "m", "md5").select(F.col("propGN").cast("long").alias("game_id"), big("m", "movect"), F.col("md5").alias("sig"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def ok_files_anti(spark, sf):
    found = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("path"))
    return check.files_without(table(spark, sf, "customer").select(F.col("c_custkey").alias("path")), found).select(F.col("path").alias("c_custkey"))


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P')")
def nok_files_semi(spark, sf):
    found = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("path"))
    return check.files_with(table(spark, sf, "customer").select(F.col("c_custkey").alias("path")), found).select(F.col("path").alias("c_custkey"))


@query("select cast(case when count(*) = 5 then 0 when count(*) < 5 then -1 else 1 end as bigint) as code from region")
def assert_one(spark, sf):
    return spark.createDataFrame([(check.assert_count(table(spark, sf, "region"), 5, 5),)], "code long")


# ---------------------------------------------------------------- comparison and merging


@query(f"with {PAIRS} select coalesce(a.pair, b.pair) as pair, coalesce(a.k, b.k) as k, coalesce(a.mv, '--') as m1, coalesce(b.mv, '--') as m2 from (select * from a where pair in (select pair from ids)) a full outer join (select * from b where pair in (select pair from ids)) b on a.pair = b.pair and a.k = b.k where a.mv is distinct from b.mv")
def diff_positional(spark, sf):
    d = pairs(spark, sf).select("pair", F.inline(compare.differences(F.col("a"), F.col("b"))))
    return d.select("pair", big("k", "k"), "m1", "m2")


HIST = PAIRS + """, ha as (select pair, mv, count(*) as n from a group by pair, mv), hb as (select pair, mv, count(*) as n from b group by pair, mv)"""


@query(f"with {HIST} select coalesce(ha.pair, hb.pair) as pair, cast(sum(abs(coalesce(ha.n, 0) - coalesce(hb.n, 0))) as bigint) as distance from (select * from ha where pair in (select pair from ids)) ha full outer join (select * from hb where pair in (select pair from ids)) hb on ha.pair = hb.pair and ha.mv = hb.mv group by 1")
def diff_histogram(spark, sf):
    return pairs(spark, sf).select("pair", big(compare.histogram_distance(F.col("a"), F.col("b")), "distance"))


@query(f"""with {PAIRS}, sa as ({' union all '.join(f"select pair, {t} as t, case when is_pass = 1 then 'tt' else chr(cast(97 + {a} as int)) || chr(cast(97 + {b} as int)) end as mv from a where pair in (select pair from ids)" for t, (a, b) in enumerate(EIGHT))}),
sb as (select pair, t, mv from b cross join (select unnest(range(8)) as t) where pair in (select pair from ids)),
ha as (select pair, t, mv, count(*) as n from sa group by all), hb as (select pair, t, mv, count(*) as n from sb group by all),
d as (select coalesce(ha.pair, hb.pair) as pair, coalesce(ha.t, hb.t) as t, cast(sum(abs(coalesce(ha.n, 0) - coalesce(hb.n, 0))) as bigint) as distance from ha full outer join hb on ha.pair = hb.pair and ha.t = hb.t and ha.mv = hb.mv group by 1, 2)
select pair, cast(t as bigint) as t, distance from (select *, row_number() over (partition by pair order by distance, t) as r from d) where r = 1""")
def diff_best_symmetry(spark, sf):
    return compare.best_symmetry(pairs(spark, sf)).select("pair", big("t", "t"), big("distance", "distance"))


@query(f"with {PAIRS}, d as (select a.pair, min(case when a.mv <> b.mv then a.k end) as k, count(*) as n from a join b on a.pair = b.pair and a.k = b.k group by a.pair) select pair, coalesce(k - 1, n) as prefix from d")
def common_prefix(spark, sf):
    return pairs(spark, sf).select("pair", big(compare.common_prefix(F.col("a"), F.col("b")), "prefix"))


@query(f"with {MOVES}, n as (select game_id as g, count(*) as n from moves group by game_id) select game_id as pair, case when n <= 50 then 'identical' else 'truncation' end as verdict from (select distinct game_id from moves) join n on g = game_id")
def truncation_identical(spark, sf):
    g = games(spark, sf)
    return g.select(F.col("game_id").alias("pair"), compare.verdict(moves.truncated(F.col("moves"), keep=50), F.col("moves")).alias("verdict"))


@query(f"with {PAIRS}, n as (select a.pair, count(distinct a.k) as la from a group by a.pair), m as (select b.pair, count(distinct b.k) as lb from b group by b.pair) select n.pair, greatest(la, lb) as longest from n join m on n.pair = m.pair")
def merge_moves(spark, sf):
    merged = compare.merged_moves(F.col("a"), F.col("b"), most=1000)
    return pairs(spark, sf).select("pair", merged.alias("m")).select("pair", big(F.size("m.moves"), "longest"))


@query("select n_regionkey as key, string_agg(name, ',' order by name) as names from (select distinct n_regionkey, n_name as name from nation union select n_regionkey, n_name from nation union select r_regionkey, r_name from region) group by n_regionkey")
def merge_union_dedupe(spark, sf):
    vals = lambda c: F.array(F.col(c))
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("key"), edit.prop("N", vals("n_name")).alias("p"))
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("key"), edit.prop("N", vals("r_name")).alias("p"))
    gather = lambda d: d.groupBy("key").agg(F.collect_list("p").alias("ps"))
    both = gather(n.union(n)).withColumnRenamed("ps", "a").join(gather(r).withColumnRenamed("ps", "b"), "key")
    names = F.transform(compare.merged_properties(F.col("a"), F.col("b")), lambda p: F.get(p["vals"], F.lit(0)))
    return both.select("key", F.array_join(F.array_sort(names), ",").alias("names"))


@query("select o_orderkey as game_id, 'B+R' as re from orders where o_orderkey % 3 = 0 union all select o_orderkey, case when o_orderkey % 3 = 1 then 'B+,W+R' else 'B+' end from orders where o_orderkey % 3 <> 0")
def merge_result_subsume(spark, sf):
    other = F.when(F.col("o_orderkey") % 3 == 0, "B+R").when(F.col("o_orderkey") % 3 == 1, "W+R").otherwise("B+")
    ps = lambda v: F.array(edit.prop("RE", F.array(v)))
    merged = compare.merged_properties(ps(F.lit("B+")), ps(other))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("game_id"), F.array_join(F.flatten(F.transform(merged, lambda p: p["vals"])), ",").alias("re"))


@query("select conv_id, string_agg(role || ':' || cast(length(text) as varchar), '.' || chr(10) order by turn) as gc from conversations group by conv_id")
def gc_listagg(spark, sf):
    c = table(spark, sf, "conversations")
    note = F.concat("role", F.lit(":"), F.char_length("text").cast("string"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", note.alias("n")))), lambda s: s["n"])
    return c.groupBy("conv_id").agg(compare.joined_notes(ordered).alias("gc"))


# ---------------------------------------------------------------- validation


def one_node(spark, sf, name: Column) -> DataFrame:
    """Orders as games of one node, with a property for each line."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("game_id"), edit.prop(name, F.array("l_linestatus")).alias("p"))
    node = F.struct(F.lit(0).alias("node_id"), F.lit(True).alias("is_main"), F.col("ps").alias("props"))
    g = li.groupBy("game_id").agg(F.collect_list("p").alias("ps")).select("game_id", F.array(node).alias("nodes"))
    none = F.array().cast("array<struct<color:string,x:int,y:int,mv:string>>")
    return g.withColumns({"moves": none, "setup": F.lit(0), "abct": F.lit(0), "awct": F.lit(0)})


def broken(spark, sf, rule: str, name: Column) -> DataFrame:
    """The games that break a rule of the validator."""
    return one_node(spark, sf, name).where(F.size(dict(check.node_issues())[rule]) > 0).select("game_id")


@query(f"with {LINES} select game_id from l group by game_id having count(*) > count(distinct rf)")
def dup_ids(spark, sf):
    return broken(spark, sf, "duplicate", F.col("l_returnflag"))


@query(f"with {MOVES}, c as (select game_id, k, case when x % 2 = 0 then 'B' else 'W' end as c from moves), p as (select *, lag(c) over (partition by game_id order by k) as q from c) select game_id, k from p where c = q")
def same_color_twice(spark, sf):
    rows = move_rows(spark, sf).withColumn("color", F.when(F.col("x") % 2 == 0, "B").otherwise("W"))
    return board.lagged(rows).where("color = previous_color").select("game_id", "k")


@query("select l_orderkey as game_id from lineitem group by l_orderkey having bool_or(l_returnflag = 'R') and bool_or(l_returnflag = 'N')")
def mixed_classes(spark, sf):
    return broken(spark, sf, "mixed", F.when(F.col("l_returnflag") == "R", "B").when(F.col("l_returnflag") == "N", "AB").otherwise("C"))


@query("select o_orderkey as game_id from orders where (o_orderkey % 14) % 2 <> (o_custkey % 30) % 2")
def km_re_integer(spark, sf):
    half = lambda c: F.concat((F.floor(c / 2)).cast("string"), F.when(c % 2 == 1, ".5").otherwise(""))
    km, re = half(F.col("o_orderkey") % 14), F.concat(F.when(F.col("o_orderkey") % 3 == 0, "W+").otherwise("B+"), half(F.col("o_custkey") % 30))
    return table(spark, sf, "orders").where(~check.komi_fits_result(km, re)).select(F.col("o_orderkey").alias("game_id"))


@query(f"with {MOVES} select game_id, x, y, max(k) as k, arg_max(color, k) as color from moves where is_pass = 0 group by game_id, x, y")
def last_event_per_point(spark, sf):
    return board.last_events(move_rows(spark, sf).where("not is_pass")).select("game_id", "x", "y", "k", "color")


PATTERN = "(;SZ[19]AB[dd][pq]AW[jj])"


@query(f"""with {MOVES}, want as (select * from (values (3, 3, 'B'), (15, 16, 'B'), (9, 9, 'W')) as v(px, py, want)),
h as (select game_id, k, x, y, case when color = want then 1 else 0 end as holds from moves join want on x = px and y = py where is_pass = 0),
d as (select game_id, k, holds - coalesce(lag(holds) over (partition by game_id, x, y order by k), 0) as delta from h),
r as (select game_id, k, sum(delta) over (partition by game_id order by k rows unbounded preceding) as run from d)
select game_id, min(k) as first_move from r where run = 3 group by game_id""")
def pattern_first_move(spark, sf):
    size, wanted = pattern.constraints(PATTERN)
    events = move_rows(spark, sf).where("not is_pass").select("game_id", "k", F.col("k").alias("move_nr"), "color", "x", "y", F.lit(False).alias("is_capture"))
    found = pattern.first_match(events, pattern.variants(wanted, size - 1), order="k")
    return found.select("game_id", "first_move")


SINGLE = "(;SZ[19]AB[cd])"


@query(f"""with {MOVES}, want as (select * from (values (2, 3), (2, 15), (3, 16), (3, 2), (16, 15), (16, 3), (15, 2), (15, 16)) as v(px, py))
select game_id, min(k) as first_move from moves join want on x = px and y = py where is_pass = 0 group by game_id""")
def pattern_all_symmetries(spark, sf):
    size, wanted = pattern.constraints(SINGLE)
    events = move_rows(spark, sf).where("not is_pass").select("game_id", "k", F.col("k").alias("move_nr"), "color", "x", "y", F.lit(False).alias("is_capture"))
    found = pattern.first_match(events, pattern.variants(wanted, size - 1, all_symmetries=True, swap=True), order="k")
    return found.select("game_id", "first_move")


# ---------------------------------------------------------------- normal forms


def _spelled(spark, sf, forms: list[str], key: str = "o_orderkey") -> DataFrame:
    """Each order with one of the spellings, {n} being its key modulo 9, plus 1."""
    n = (F.col(key) % 9 + 1).cast("string")
    return table(spark, sf, "orders").select(F.col(key).alias("game_id"), F.replace(F.element_at(F.array(*[F.lit(x) for x in forms]), (F.col(key) % len(forms) + 1).cast("int")), F.lit("{n}"), n).alias("v"))


def _norm_sql(outs: list[str]) -> str:
    cases = " ".join(f"when {i} then '{o}'" for i, o in enumerate(outs))
    return f"select o_orderkey as game_id, replace(case o_orderkey % {len(outs)} {cases} end, '{{n}}', cast(o_orderkey % 9 + 1 as varchar)) as v from orders"


RANKS = {"{n}th dan": "{n}d", "{n}-Dan": "{n}d", "{n} dan": "{n}d", "{n}e dan": "{n}d", "{n} kyu": "{n}k", "{n} dan pro": "{n}p", "6d pro": "6d pro", "{n}d": "{n}d"}
TIMES = {"{n} hours each": "{n}h", "{n} hours": "{n}h", "1 hour each": "1h", "7h36m": "7h36m"}
KOMIS = {"{n},5": "{n}.5", "5 1/2": "5.5", "2 3/4": "2.75", "none": "0", "Reverse, 20p": "-20", "-64.50": "-64.5", "0.000000": "0", "{n}": "{n}", "214": "2.25", "6.5 points": "6.5", "abc": "abc"}
RESULTS_IN = {"W+{n}目": "W+{n}", "和棋": "0", "B+中押胜": "B+R", "B+Resign": "B+R", "B+T": "B+T", "Black wins by 1 1/2 pts.": "B+1.5", "B+.75": "B+0.75", "White + 3": "W+3", "Draw - triple ko": "0", "unknown": "?", "W+3points": "W+3", "Void": "Void", "B+0.5 (W connects ko)": "B+0.5", "W wins": "W+", "game suspended": "game suspended"}


@query(_norm_sql(list(RANKS.values())))
def norm_rank(spark, sf):
    return _spelled(spark, sf, list(RANKS)).select("game_id", normalize.rank(F.col("v")).alias("v"))


@query(_norm_sql(list(TIMES.values())))
def norm_time(spark, sf):
    return _spelled(spark, sf, list(TIMES)).select("game_id", normalize.time(F.col("v")).alias("v"))


@query(_norm_sql(list(KOMIS.values())))
def norm_komi(spark, sf):
    return _spelled(spark, sf, list(KOMIS)).select("game_id", normalize.komi(F.col("v")).alias("v"))


@query(_norm_sql(list(RESULTS_IN.values())))
def norm_result(spark, sf):
    return _spelled(spark, sf, list(RESULTS_IN)).select("game_id", normalize.result(F.col("v")).alias("v"))


@query("select o_orderkey as game_id, strftime(o_orderdate, '%Y-%m-%d') as v from orders")
def norm_date(spark, sf):
    spelled = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "d MMMM yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "MMM d, yyyy"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("game_id"), normalize.dates(spelled).alias("v"))


# ---------------------------------------------------------------- editing


@query(f"with {LINES} select game_id, cast(sum(case when n % 2 = 1 then 1 else 0 end + case when rf = 'R' then 0 else 1 end) as bigint) as left_props from l group by game_id")
def strip_props(spark, sf):
    rules = [edit.StripRule.parse("RF=R")]
    kept = edit.stripped(F.col("nodes"), rules)
    several = F.filter(F.flatten(F.transform(kept, lambda n: n["props"])), lambda p: (p["id"] == "RF") | (F.size(p["vals"]) > 1))
    return order_nodes(spark, sf).select("game_id", big(F.size(several), "left_props"))


@query("select doc_id, replace(replace(text, chr(10), ' '), chr(13), ' ') as text from documents")
def replace_nl(spark, sf):
    return table(spark, sf, "documents").select("doc_id", properties.one_line(F.col("text")).alias("text"))


@query("select s_suppkey as game_id, case when s_nationkey % 2 = 0 then 0 else s_suppkey % 9 end as h from supplier")
def handicap(spark, sf):
    s = table(spark, sf, "supplier")
    awct = F.when(F.col("s_nationkey") % 2 == 0, 1).otherwise(0)
    return s.select(F.col("s_suppkey").alias("game_id"), big(properties.handicap(F.col("s_suppkey") % 9, awct), "h"))


# ---------------------------------------------------------------- rows only: sequential or not in SQL


@query(None)
def board_replay(spark, sf):
    """Each game's moves until the first illegal one, replayed."""
    g = games(spark, sf).withColumns({"size": F.lit(19), "setup": F.lit(0)})
    e = board.with_plays(g)
    return e.select("game_id", big(F.size("plays.events"), "n_events"), big(board.captured(F.col("plays.events")), "captured"), F.col("plays.error_rule").alias("ended_by"))


@query(f"""with {PAIRS}, fa as (select * from a where pair in (select pair from ids)), fb as (select * from b where pair in (select pair from ids)),
ua as (select pair, mv, min(k) as k1 from fa group by pair, mv having count(*) = 1), ub as (select pair, mv, min(k) as k2 from fb group by pair, mv having count(*) = 1),
anchors as (select ua.pair, k1, k1 - k2 as d from ua join ub on ua.pair = ub.pair and ua.mv = ub.mv),
cells as (select fa.pair, s.d, fa.k as k1, n.k1 as anchor from fa join (select distinct pair, d from anchors) s on s.pair = fa.pair join fb on fb.pair = fa.pair and fb.k = fa.k - s.d and fb.mv = fa.mv left join anchors n on n.pair = fa.pair and n.d = s.d and n.k1 = fa.k),
islands as (select pair, d, min(k1) as low, max(k1) as high, min(anchor) as anchor from (select *, k1 - row_number() over (partition by pair, d order by k1) as g from cells) group by pair, d, g having min(anchor) is not null),
shared as (select pair, greatest(low, coalesce(lag(high) over (partition by pair order by anchor) + 1, 1)) as k1, high, d from islands),
held as (select pair, k1, k1 - d as k2, high - k1 + 1 as length from shared),
sizes as (select pair, (select count(*) from fa where fa.pair = ids.pair) as n1, (select count(*) from fb where fb.pair = ids.pair) as n2 from ids),
alone1 as (select fa.pair, k, k - row_number() over (partition by fa.pair order by k) as g from fa where not exists (select 1 from held h where h.pair = fa.pair and fa.k between h.k1 and h.k1 + h.length - 1)),
alone2 as (select fb.pair, k, k - row_number() over (partition by fb.pair order by k) as g from fb where not exists (select 1 from held h where h.pair = fb.pair and fb.k between h.k2 and h.k2 + h.length - 1))
select pair, 3::bigint as type, k1::bigint as k1, k2::bigint as k2, length::bigint as length from held
union all select pair, 1, min(k), null, count(*) from (select a1.*, coalesce((select count(*) from held h where h.pair = a1.pair and h.k1 < a1.k), 0) as part from alone1 a1) group by pair, g, part
union all select pair, 2, null, min(k), count(*) from alone2 group by pair, g""")
def chunk_diff(spark, sf):
    """What each game and the next share, and what is in one alone."""
    found = chunks.chunks(pairs(spark, sf))
    return found.select("pair", big("type", "type"), big("k1", "k1"), big("k2", "k2"), big("length", "length"))


__all__ = ["ORACLE", "QUERIES", "games", "move_rows", "pairs", "swapped"]
