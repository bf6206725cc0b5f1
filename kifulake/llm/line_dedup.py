r"""Line dedup by a segment-partition edit join, with DataFrame functions alone.

A line is what stands between line feeds; one without a character other than white space
is blank and never removed. Lines come in the order of doc_id (null last), place of the
row in the table, line number. A line goes if an equal line came before it, or if the
first occurrence of another text within its budget of edits did. The budget of two lines is
an edit for each ``PER_EDIT`` characters of the shorter one, ``edits`` at most, so none below
``PER_EDIT`` characters, where one edit makes another word of a word.

The join: distinct lines only. Each is cut into budget + 1 segments, one of which must occur
unchanged in any line within that many edits, shifted by no more than the lengths allow; so
each line looks up, for each length it may match, its substrings at the shifts that are left
when each segment is taken to be the first that fits. Lookups are hashes of length, segment
number and substring, joined by equality; pairs whose counts of characters are too far apart
are left out there. What is found is verified by a banded bit-parallel edit distance: the
2 * edits + 1 diagonals around the main one are the bits of a BIGINT, which moves down the
matrix a character at a time (Hyyro's form of Myers' algorithm).

Null text counts as empty; a very long text or line is taken whole; repeated rows are
documents of their own, the later ones losing their lines to the first; an empty table gives
an empty result; other columns are carried along, whatever their names. Rows are told apart
as ``common.numbered`` says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, numbered, saved, small

EDITS, PER_EDIT = 2, 16
ID, ROW = ["h1", "h2"], ["f", "r"]


def _rows(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs numbered, with its text as ``whole``; the columns' names there."""
    rows, at = numbered(docs)
    return rows.withColumn("whole", F.coalesce(F.col(at["text"]).cast("string"), F.lit(""))), at


def _lines(rows: DataFrame, doc_id: str) -> DataFrame:
    """f, r, doc_id, n, line and its two hashes, for lines that aren't blank."""
    each = rows.select(*ROW, F.col(doc_id).alias("doc_id"), F.posexplode(F.split("whole", "\n", -1)).alias("n", "line")).where(F.col("line").rlike(r"\S"))
    return each.select(*ROW, "doc_id", "n", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def budget(length: Column, edits: int = EDITS) -> Column:
    return F.least(F.floor(length / PER_EDIT).cast("int"), F.lit(edits))


def _segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 0): the last ones take what is left over."""
    base, longer = F.floor(length / (edits + 1)).cast("int"), (length % (edits + 1)).cast("int")
    first = F.lit(edits + 1) - longer  # the first segment that is longer by one
    extra = F.greatest(F.lit(i) - first, F.lit(0))
    return (base * i + extra + 1).cast("int"), F.when(F.lit(i) >= first, base + 1).otherwise(base)


def _key(line: Column, length: Column, i: int, shift: int, edits: int) -> Column:
    start, size = _segment(length, i, edits)
    return F.xxhash64(length, F.lit(i + 8 * edits), F.substring(line, start + shift, size))


def shifts(i: int, difference: int, edits: int) -> range:
    """Of segment i (from 0), where the line that looks up is longer by ``difference``."""
    return range(max(-i, difference - (edits - i)), min(i, difference + (edits - i)) + 1)


def lookups(line: Column, size: Column, edits: int = EDITS) -> tuple[list[Column], list[int]]:
    """All that a line looks up, null where that is for other lengths; and which of these are
    its own segments, by which it is found."""
    keys, own = [], []
    for most in range(1, edits + 1):  # the budget of the line that is found, which is the shorter one
        for d in range(most + 1):
            fits = (size - d >= PER_EDIT * most) if most == edits else (size - d).between(PER_EDIT * most, PER_EDIT * (most + 1) - 1)
            for i in range(most + 1):
                for s in sorted(shifts(i, d, most), key=abs):
                    if d == s == 0:
                        own.append(len(keys))
                    keys.append(F.when(fits, _key(line, size - d, i, s, most)))
    return keys, own


#: Characters whose counts a line's mark holds, two bits each. Counting one reads the line once,
#: which is most of what a line costs, so there are no more than tell unlike lines apart.
MARKED = "etaoinshrdlucmgp ,01"


def mark(line: Column) -> Column:
    """Counts of some characters modulo 4, in Gray code. An edit changes two counts by one at
    most, and the bits in which two marks differ are at most what the counts differ by: so
    lines within e edits have marks that differ in 2 e bits at most."""
    size, out = F.octet_length(line), F.lit(0).cast("long")
    for i, c in enumerate(MARKED):
        n = size - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
        gray = (n.bitwiseXOR(F.shiftright(n, 1))).bitwiseAND(F.lit(1)).bitwiseOR(n.bitwiseAND(F.lit(2)))
        out = out.bitwiseOR(F.shiftleft(gray.cast("long"), 2 * i))
    return out


def near_pairs(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """Of lines (h1, h2, line), repeated or not: those that may be within their budget, as (a, b) of their h1, once each.

    The marks are compared inside the join, so lines that share a segment and little else make no rows.
    """
    size = F.char_length("line")
    keys, own = lookups(F.col("line"), size, edits)
    names = [f"k{i}" for i in range(len(keys))]
    # the keys travel instead of the text: half its bytes; numbers, so that copies are dropped by hashing, not by sorting
    keyed = lines.where(size >= PER_EDIT).select(*ID, *[k.alias(n) for k, n in zip(keys, names, strict=True)], mark(F.col("line")).alias("mark"))
    distinct = keyed.groupBy(*ID).agg(*[F.min(n).alias(n) for n in [*names, "mark"]])
    # both sides take all keys, so the lines are read and shuffled once for the two: fewer columns would be another shuffle
    every = distinct.select("h1", "mark", F.posexplode(F.array(*names)).alias("at", "key")).where("key is not null")
    held = every.where(F.col("at").isin(own)).select(F.col("h1").alias("a"), F.col("mark").alias("ma"), "key")
    asked = every.select(F.col("h1").alias("b"), F.col("mark").alias("mb"), "key")
    found = held.join(asked, (held["key"] == asked["key"]) & (F.col("a") != F.col("b")) & (F.bit_count(F.col("ma").bitwiseXOR(F.col("mb"))) <= 2 * edits))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def distance(a: Column, b: Column, most: int) -> Column:
    """Edits between two strings that aren't empty and whose lengths differ by ``most`` at most;
    any larger number than ``most`` where there are more than that.

    Bit j of the vectors is the cell of a's character i - most + j in the column of b's
    character i: up and down say where the cells' values rise and fall from the one above.
    The value followed is that of the band's last row, then of a's last character.
    """
    width = 2 * most + 1
    every = F.lit((1 << width) - 1).cast("long")
    bit = lambda x, at: F.shiftright(x, at).bitwiseAND(F.lit(1).cast("long"))

    def run(chars):
        x, y = chars["a"], chars["b"]
        n = F.size(x)

        def step(state, i):
            up, down, c = state["up"], state["down"], F.get(y, i)
            same = F.when(F.get(x, i - most) == c, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
            for j in range(1, width):
                same = same + F.when(F.get(x, i - most + j) == c, F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long"))

            def moved(diagonal):
                def after(side):
                    rise, fall, below = side["rise"], side["fall"], F.shiftright(diagonal, 1)
                    row = n - 1 - i + most  # the bit of a's last character
                    last = F.when(row < 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", rise, row).bitwiseAND(F.lit(1).cast("long")) - F.call_function("shiftright", fall, row).bitwiseAND(F.lit(1).cast("long")))
                    value = F.when(i < n - most, F.lit(1).cast("long") - bit(diagonal, width - 1)).otherwise(last)
                    return F.struct(
                        fall.bitwiseOR(F.bitwise_not(below.bitwiseOR(rise))).bitwiseAND(every).alias("up"),
                        below.bitwiseAND(rise).alias("down"),
                        (state["value"] + value).alias("value"),
                    )

                rise = down.bitwiseOR(F.bitwise_not(diagonal.bitwiseOR(up))).bitwiseAND(every)
                return _let(F.struct(rise.alias("rise"), diagonal.bitwiseAND(up).alias("fall")), after)

            return _let(same, lambda eq: _let((eq.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(eq).bitwiseOR(down).bitwiseAND(every), moved))

        first = F.struct(F.lit(((1 << (most + 1)) - 1) << most).cast("long").alias("up"), F.lit(0).cast("long").alias("down"), F.least(F.lit(most), n).cast("long").alias("value"))
        return F.aggregate(F.sequence(F.lit(0), F.size(y) - 1), first, step, lambda state: state["value"])

    return _let(_middles(a, b), lambda m: F.when((m["a"] == "") | (m["b"] == ""), F.abs(F.char_length(m["a"]) - F.char_length(m["b"])).cast("long")).otherwise(_let(F.struct(F.split(m["a"], "").alias("a"), F.split(m["b"], "").alias("b")), run)))


def _middles(a: Column, b: Column) -> Column:
    """What is left of both strings without equal ends (to eight characters), which need no edits."""

    def rest(x: Column, y: Column, step: int) -> Column:
        same = F.substring(x, 1, step) == F.substring(y, 1, step)
        cut = lambda z: F.when(same & (F.char_length(x) > step) & (F.char_length(y) > step), F.substring(z, step + 1, 1 << 30)).otherwise(z)
        return F.struct(cut(x).alias("a"), cut(y).alias("b"))

    def cut(pair: Column) -> Column:
        for step in (512, 256, 128, 64, 32, 16, 8):
            pair = _let(pair, lambda p, step=step: rest(p["a"], p["b"], step))
        return pair

    front = cut(F.struct(a.alias("a"), b.alias("b")))
    return _let(cut(_let(front, lambda p: F.struct(F.reverse(p["a"]).alias("a"), F.reverse(p["b"]).alias("b")))), lambda p: p)


def _texts(rows: DataFrame, named: DataFrame) -> DataFrame:
    """The lines whose first occurrences are named, with their text."""
    wanted = small(named.select(F.col("first.f").alias("f"), F.col("first.r").alias("r"), F.col("first.n").alias("n"), *ID, "first"))
    line = F.get(F.split("whole", "\n", -1), F.col("n"))
    return rows.select(*ROW, "whole").join(wanted, ROW).select(*ID, "first", line.alias("line"))


def _place(first: str) -> Column:
    return F.struct(F.col(first)["doc_id"].alias("doc_id"), F.col(first)["n"].alias("n"))


def verdicts(rows: DataFrame, doc_id: str, edits: int = EDITS) -> DataFrame:
    """A row for each line that isn't blank: f, r, doc_id, n, copy (an equal line came
    before), near (a line within the budget did), links (texts within it), first (doc_id
    and n of its text's first occurrence), others (those of the linked texts; on first occurrences)."""
    lines = _lines(rows, doc_id)
    occ = lines.drop("line")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "f", "r", "n")
    first = occ.groupBy(*ID).agg(F.min(order).alias("first"))
    pairs = saved(near_pairs(lines, edits), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct()
    named = saved(first.join(ends, "h1", "left_semi"), "lines")
    texts = saved(_texts(rows, named), "texts")
    a = texts.select(F.col("h1").alias("a"), F.col("h2").alias("a2"), F.col("line").alias("ta"), F.col("first").alias("fa"))
    b = texts.select(F.col("h1").alias("b"), F.col("h2").alias("b2"), F.col("line").alias("tb"), F.col("first").alias("fb"))
    la, lb = F.char_length("ta"), F.char_length("tb")
    both = pairs.join(a, "a").join(b, "b").where(F.abs(la - lb) <= budget(F.least(la, lb), edits))
    close = both.where(distance(F.col("ta"), F.col("tb"), edits) <= budget(F.least(la, lb), edits))
    ends = F.inline(F.array(F.struct(F.col("a").alias("h1"), F.col("a2").alias("h2"), (F.col("fb") < F.col("fa")).alias("late"), _place("fb").alias("other")), F.struct(F.col("b").alias("h1"), F.col("b2").alias("h2"), (F.col("fa") < F.col("fb")).alias("late"), _place("fa").alias("other"))))
    linked = saved(close.select(ends).groupBy(*ID).agg(F.count("*").alias("links"), F.bool_or("late").alias("near"), F.array_sort(F.collect_list("other")).alias("others")), "linked")
    discard(pairs, named, texts)
    known = first.join(linked, ID, "left").select(*ID, "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("near", F.lit(False)).alias("near"), "others")
    same = (F.col("first")["f"] == F.col("f")) & (F.col("first")["r"] == F.col("r")) & (F.col("first")["n"] == F.col("n"))
    return occ.join(known, ID).select(*ROW, "doc_id", "n", (~same).alias("copy"), (same & F.col("near")).alias("near"), "links", _place("first").alias("first"), F.when(same, F.col("others")).alias("others"))


def line_report(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """A row for each document: doc_id, n_lines (that aren't blank), n_copies, n_near, n_links,
    removed (the numbers, from 0, of the lines that go), members (n, first, others of each line
    that is a copy or has links: what it is an occurrence of, and on the first occurrence the
    verified pairs, so each pair is there once from either side)."""
    rows, at = _rows(docs)
    v = verdicts(rows, at["doc_id"], edits)
    goes = F.col("copy") | F.col("near")
    whole = v.groupBy(*ROW).agg(F.count("*").alias("n_lines"), F.count_if(F.col("copy")).alias("n_copies"), F.count_if(F.col("near")).alias("n_near"), F.sum("links").alias("n_links"), F.array_sort(F.collect_list(F.when(goes, F.col("n")))).alias("removed"), F.array_sort(F.collect_list(F.when(F.col("copy") | (F.col("links") > 0), F.struct("n", "first", "others")))).alias("members"))
    none = {"n_lines": 0, "n_copies": 0, "n_near": 0, "n_links": 0}
    return rows.select(*ROW, F.col(at["doc_id"]).alias("doc_id")).join(whole, ROW, "left").select("doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in none], F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), F.coalesce("members", F.array()).alias("members"))


def without_repeats(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """The documents without the lines that go; n_chars, where there is such a column, follows.
    A document that had lines and has none left goes too."""
    rows, at = _rows(docs)
    v = verdicts(rows, at["doc_id"], edits)
    gone = v.groupBy(*ROW).agg(F.array_sort(F.collect_list(F.when(F.col("copy") | F.col("near"), F.col("n")))).alias("gone"), F.count("*").alias("lines")).where("size(gone) > 0")
    kept = rows.join(gone, ROW, "left").where("gone is null or size(gone) < lines")
    split = F.split("whole", "\n", -1)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone")), lambda i: F.get(split, i))
    out = {n: F.col(c) for n, c in at.items()}
    out["text"] = F.when(F.col("gone").isNull(), F.col(at["text"]).cast("string")).otherwise(F.array_join(left, "\n"))
    if "n_chars" in at:
        out["n_chars"] = F.when(F.col("gone").isNull(), out["n_chars"]).otherwise(F.char_length(out["text"]).cast(docs.schema["n_chars"].dataType))
    return kept.select(*[c.alias(n) for n, c in out.items()])
