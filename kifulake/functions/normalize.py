"""Normal forms of the values of game information.

Rank, time, komi and result are chains of native string expressions. Dates need a small
grammar over words in several languages, which is an Arrow UDF; values that are already
in normal form are passed by before it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RESIGN_WORDS = "中押し?[勝胜]ち?|[勝胜]ち?\\(中押し?\\)|中盤勝ち?|不計點勝"


def bound(c: Column, body) -> Column:
    """body(v) with v standing for c's value: c is computed once, however often body names v."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def rank(c: Column) -> Column:
    """'9th dan', '9-Dan', '9e dan' as '9d', 'kyu' as k; ' pro' behind a rewritten dan as 'p'."""
    dan = F.regexp_replace(c, r"(?i)^\s*(\d+)\s*(?:st|nd|rd|th|e)?[\s-]*dan\s*pro\s*$", "$1p")
    dan = F.regexp_replace(dan, r"(?i)^\s*(\d+)\s*(?:st|nd|rd|th|e)?[\s-]*dan\s*$", "$1d")
    return F.regexp_replace(dan, r"(?i)^\s*(\d+)\s*(?:st|nd|rd|th|e)?[\s-]*kyu\s*$", "$1k")


def time(c: Column) -> Column:
    """'8 hours each' as '8h'."""
    return F.regexp_replace(c, r"(?i)^\s*(\d+)\s*hours?(?:\s+each)?\.?\s*$", "$1h")


def decimal(c: Column) -> Column:
    """A plain decimal without needless zeros; '.5' as '0.5'."""
    c = F.regexp_replace(c, r"^(-?)\.(\d)", "$10.$2")
    c = F.regexp_replace(c, r"^(-?)0+(\d)", "$1$2")
    c = F.regexp_replace(c, r"(\.\d*?)0+$", "$1")
    c = F.regexp_replace(c, r"\.$", "")
    return F.regexp_replace(c, "^(-0)?$", "0")


def quarters(c: Column) -> Column:
    """'5 1/2', '2 3/4', '2 1/4', '1/2' as decimals; other text stays."""
    for part, digits in (("1/2", "5"), ("1/4", "25"), ("3/4", "75")):
        c = F.regexp_replace(c, rf"(-?\d+)\s+{part}", f"$1.{digits}")
        c = F.regexp_replace(c, rf"(?<![\d/]){part}(?!\d)", f"0.{digits}")
    return c


def doubled(c: Column) -> Column:
    """Quarter points doubled, for countings where a stone is a point on either side."""
    return bound(c, lambda v: F.when(v.rlike(r"^-?\d+\.(25|75)$"), decimal((v.cast("decimal(9,2)") * 2).cast("string"))).otherwise(v))


def komi(c: Column, japanese: bool = False) -> Column:
    """A decimal where the value can be read, else the value."""
    t = F.regexp_replace(F.trim(c), r"(?i)^reverse[,\s]*", "-")
    t = F.regexp_replace(t, "^--", "-")
    t = F.regexp_replace(t, r"(?i)\s*(p|pts?|points?|目|子)\.?\s*$", "")
    t = F.regexp_replace(t, r"(\d),(\d)", "$1.$2")
    t = F.regexp_replace(t, r"^(\d)(1|3)4$", "$1 $2/4")  # 214, 234: a blank and a stroke were lost
    t = F.regexp_replace(quarters(t), "(?i)^(none|no|无|無)$", "0")

    def shown(v):
        n = decimal(v)
        return F.when(v.rlike(r"^-?(\d+(\.\d*)?|\.\d+)$"), doubled(n) if japanese else n)

    return F.coalesce(bound(t, shown), c)


def result(c: Column, japanese: bool = False) -> Column:
    """B+3.5, W+R, W+T, W+F, 0, Void or ?, where the value can be read, else the value."""
    t = F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*[({].*[)}]\s*$", ""), "目[。.]?$", ""))
    t = F.rtrim(F.regexp_replace(F.lower(t), r"[.!。！]+$", ""))
    return F.coalesce(bound(t, lambda low: _result(low, japanese)), c)


def _result(low: Column, japanese: bool) -> Column:
    side = F.when(low.rlike("^(b|black|黒|黑)"), "B").when(low.rlike("^(w|white|白)"), "W")
    score = F.regexp_extract(quarters(F.regexp_replace(low, r"(\d),(\d)", "$1.$2")), r"(\d+(?:\.\d+)?|\.\d+)\s*(?:p|pts?|points?|moku|目|子)?\s*$", 1)

    def decided(x):
        by, points = x["side"], x["score"]
        other = F.when(by == "B", "W").otherwise("B")
        return (
            F.when(low.rlike(r"\+\s*(by\s+)?r(es(ign(ation)?)?)?$|resign|中押|不計"), F.concat(by, F.lit("+R")))
            .when(low.rlike(r"\+\s*t(ime)?$|(wins|forfeits?|loses)\s+(on|by)\s+time"), F.concat(F.when(low.rlike("forfeits|loses"), other).otherwise(by), F.lit("+T")))
            .when(low.rlike(r"\+\s*(by\s+)?f(orf[ae]it)?$"), F.concat(by, F.lit("+F")))
            .when(low.rlike(r"\+\s*[j0]$"), "0")
            .when(low.rlike(r"^[bw]\+?$|wins?$|\+\s*\?$") & (points == ""), F.concat(by, F.lit("+")))
            .when((points != "") & low.rlike(r"\+|win|勝|胜"), F.concat(by, F.lit("+"), doubled(decimal(points)) if japanese else decimal(points)))
        )

    return (
        F.when(low.isin("?", "unknown"), "?")
        .when(low.isin("0", "jigo", "j", "和棋", "持碁") | low.rlike("^draw"), "0")
        .when(low.isin("nr", "null", "no result", "無勝負") | low.rlike("^void"), "Void")
        .when(side.isNotNull(), bound(F.struct(side.alias("side"), score.alias("score")), decided))
    )


#: Names of months, by their first three letters; ends of ordinals; words between.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: The year before the first year of an era, and its names.
ERAS = {"heisei": 1988, "平成": 1988, "showa": 1925, "昭和": 1925, "taisho": 1911, "大正": 1911, "meiji": 1867, "明治": 1867}
LISTING = re.compile(r"\s*(,|;|&|\band\b|\bor\b)\s*")
SPAN = re.compile(r"\s*(\.\.|〜|~|\bto\b|\buntil\b)\s*")
_M, _D = "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12]\\d|3[01])"
ISO = re.compile(rf"\d{{4}}(?:-{_M}(?:-{_D})?)?(?:(?:,|\.\.)(?:\d{{4}}(?:-{_M}(?:-{_D})?)?|{_M}-{_D}|{_D}))*\Z")


def date(value: str) -> str | None:
    """A list of dates as 1996-10-02,03 or with spans 1999-12-06..2000-01-03; None: not understood."""
    text = value.strip().rstrip(".?")
    if ISO.match(text):
        return text
    text = "".join(chr(ord(c) - 0xFEE0) if "０" <= c <= "９" else c for c in text).lower()
    text = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", text).strip().rstrip(".?").strip()
    text = re.sub(r"(?<=\d)(st|nd|rd|th|er|e)\b", "", text)
    text = re.sub(r"\b(of|the|de|from|on)\b", " ", text)
    text = re.sub(r"(?<=日)(播放|放送).*", "", text)
    for name, before in ERAS.items():
        text = re.sub(rf"{name}\s*(\d+|元)\s*年?", lambda m, b=before: f"{b + (1 if m[1] == '元' else int(m[1]))}年", text)
    if m := re.fullmatch(r"(\d{4})(\d\d)(\d\d)", text) or re.fullmatch(r"(\d{4})-(\d\d)(\d\d)", text):
        return _iso([(int(m[1]), int(m[2]), int(m[3]), ",")])
    text = re.sub(r"\s+-\s+", "..", text)
    if re.search(r"\d\s*-\s*\d+\.\d+\.\d{4}", text):
        text = re.sub(r"(\d)\s*-\s*(?=\d+\.\d+\.\d{4})", r"\1..", text)
    if re.search("|".join(MONTHS), text) and not re.search(r"\d-[a-z]|[a-z]-\d", text):
        text = re.sub(r"(?<=\d)\s*-\s*(?=\d{1,2}\b)", "..", text)
    text = SPAN.sub(" .. ", LISTING.sub(" , ", text))
    parts = [p for p in re.split(r"(\.\.|,)", text) if p.strip()]
    if not parts:
        return None
    items, join = [], ","
    for p in parts:
        if p in (",", ".."):
            join = p
            continue
        found = _one(p.strip())
        if found is None:
            return None
        for k, f in enumerate(found):
            items.append([*f, join if k == 0 else ","])
        join = ","
    behind = bool(re.match(r"\s*\d{1,2}\b[^a-z]*[a-z]", parts[0])) or not re.search(r"[a-z]|\d{4}", parts[0])
    return _iso(_filled(items, behind)) if items else None


def _one(text: str) -> list[list[int | None]] | None:
    """[year, month, day] of each date in a part without commas; '2/3 october 1996' has two."""
    year = month = None
    if m := re.search(r"(\d{1,4})年", text):
        year, text = int(m[1]), text.replace(m[0], " ", 1)
    if m := re.search(r"(\d{1,2})月", text):
        month, text = int(m[1]), text.replace(m[0], " ", 1)
    text = text.replace("日", " ")
    if m := re.search(r"'(\d\d)\b", text):
        year, text = 1900 + int(m[1]), text.replace(m[0], " ", 1)
    words = re.findall(r"[a-z]+", text)
    named = [w for w in words if w[:3] in MONTHS and len(w) >= 3]
    if len(words) != len(named) or len(named) > 1:
        return None
    if named:
        month = MONTHS.index(named[0][:3]) + 1
        text = text.replace(named[0], " ", 1)
    if re.search(r"[^\d\s./\-]", text):
        return None
    numbers = [int(x) for x in re.findall(r"\d+", text)]
    long = [n for n, x in zip(numbers, re.findall(r"\d+", text), strict=True) if len(x) == 4]
    if len(long) > 1:
        return None
    if long and year is None:
        at = numbers.index(long[0])
        year = long[0]
        before, after = numbers[:at], numbers[at + 1 :]
        if month is None:
            if not before:  # 1999 12 29 30 ...
                month = after[0] if after else None
                days = after[1:]
            else:  # 30 12 1999
                if after or len(before) < 1:
                    return None
                month, days = before[-1], before[:-1]
        else:
            days = before + after
    elif month is not None:
        if year is None and len(numbers) == 1 and numbers[0] > 31:
            year, days = 1900 + numbers[0], []
        else:
            days = numbers
    elif year is not None:
        month, days = (numbers[0], numbers[1:]) if numbers else (None, [])
    else:
        if len(numbers) == 2:
            month, days = numbers[0], numbers[1:]
        elif len(numbers) == 1:
            days = numbers
        else:
            return None
    if (month is not None and not 1 <= month <= 12) or any(not 1 <= d <= 31 for d in days):
        return None
    return [[year, month, d] for d in days] or [[year, month, None]]


def _filled(items: list[list], behind: bool) -> list[tuple]:
    """Years and months that a list gives once: for the items before them where the month
    stands behind the day ('30 and 31 December'), else for those after them."""
    for field in (1, 0):
        forth, back = range(1, len(items)), range(len(items) - 2, -1, -1)
        for order, step in ((back, 1), (forth, -1)) if behind else ((forth, -1), (back, 1)):
            for k in order:
                if items[k][field] is None and (field == 0 or items[k][2] is not None):
                    items[k][field] = items[k + step][field]
    return [tuple(x) for x in items]


def _iso(items: list[tuple]) -> str | None:
    out, last = "", (None, None)
    for year, month, day, join in items:
        if year is None:
            return None
        if (month is not None and not 1 <= month <= 12) or (day is not None and not 1 <= day <= 31):
            return None
        if not out or year != last[0]:
            piece = f"{year:04d}" + (f"-{month:02d}" if month else "") + (f"-{day:02d}" if day else "")
        elif month != last[1] and month:
            piece = f"{month:02d}" + (f"-{day:02d}" if day else "")
        else:
            piece = f"{day:02d}" if day else ""
        if out and not piece:
            continue
        out += (join if out else "") + piece
        last = (year, month)
    return out


def dates(c: Column) -> Column:
    """Each value's normal form; a value that isn't understood stays."""

    @F.arrow_udf("string")
    def udf(a: pa.Array) -> pa.Array:
        found = a.dictionary_encode()  # each spelling is read once a batch
        normal = pa.array([date(v) or v for v in found.dictionary.to_pylist()], pa.string())
        return normal.take(found.indices)

    usual = c.rlike(r"^\d{4}-\d\d-\d\d$")
    # Spark runs a UDF on all rows, whatever stands around it: so it gets null where it isn't needed
    return F.when(usual, c).otherwise(udf(F.when(~usual, c)))


def comment_info(c: Column) -> dict[str, Column]:
    """PW, PB, DT, KM and RE as a root comment may tell them, one 'Name: value' to a line."""
    line = lambda names: F.nullif(F.trim(F.regexp_extract(c, rf"(?im)^\s*(?:{names})\s*[:：]\s*([^\r\n]+)", 1)), F.lit(""))
    return {"PW": line("white|白"), "PB": line("black|黒|黑"), "DT": line("date|日期|対局日"), "KM": line("komi|コミ|贴目"), "RE": line("result|結果|结果")}
