"""Other record formats, converted to the text of a record. One file is one value: an
Arrow UDF over the files scan; a file that can't be read gives null and an error."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import RESIGN_WORDS
from .sgf import arrow_type, parse

CONVERTED = "struct<text:string,error:string>"
#: Where handicap stones stand, by their number, in the two formats that say no more than that (GIB, NGF).
CORNERS = {2: "pd dp", 3: "pd dp pp", 4: "dd pd dp pp", 5: "dd pd jj dp pp", 6: "dd pd dj pj dp pp", 7: "dd pd dj jj pj dp pp", 8: "dd jd pd dj pj dp jp pp", 9: "dd jd pd dj jj pj dp jp pp"}
NGF_CORNERS = {2: "pd dp", 3: "pd dp pp", 4: "dd pd dp pp", 5: "dd pd jj dp pp", 6: "pj dj dd pp dp pd", 7: "dj jj pj pp dp dd pd", 8: "dj jp jd pj dd dp pp pd", 9: "jp jd jj dj pj dp pp dd pd"}
#: What the Nihon Ki-in's records call properties.
RENAMED = {"TE": "EV", "RD": "DT", "KO": "KM", "GK": "GM", "LT": "OT", "HD": "HA"}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("]", "\\]")


def record(props: list[tuple[str, str | list[str]]], moves: list[tuple[str, str]]) -> str:
    """A record's text from root properties and (colour, letters)."""
    head = "".join(f"{k}" + "".join(f"[{escape(x)}]" for x in ([v] if isinstance(v, str) else v)) + "\n" for k, v in props if v)
    body = "".join(("\n" if i % 10 == 0 else "") + f";{c}[{mv}]" for i, (c, mv) in enumerate(moves))
    return f"(;\n{head}{body}\n)\n"


def stones(n: int, corners: dict[int, str] = CORNERS) -> list[str]:
    return corners[n].split() if n in corners else []


def ngf(text: str) -> str:
    """Twelve header lines, then a line for each move: PM, number, colour, point twice."""
    lines = text.splitlines()
    title, size, white, black, site, handicap, _, komi, date, _, result, count = (x.strip() for x in lines[:12])
    size, handicap = int(size), int(handicap)
    if not 2 <= size <= 26:
        raise ValueError(f"bad board size {size}")
    if not re.fullmatch(r"\d{8}( \[[ \d]\d:[ \d]\d\])? ?", date):
        raise ValueError(f"bad date {date!r}")

    def player(name: str) -> tuple[str, str]:
        m = re.fullmatch(r"(.*?)\s+(\d+\s*(?:段|級|D|K|k|d)\S*?)([*P]?)", name)
        return (m[1].strip(), re.sub(r"\s*(段|D|d)", "d", re.sub(r"\s*(級|K|k)", "k", m[2])) + ("" if m[3] != "P" else "p")) if m else (name, "")

    (pb, br), (pw, wr) = player(black), player(white)
    props: list = [("PB", pb), ("BR", br), ("PW", pw), ("WR", wr)]
    if handicap > 1:
        props.append(("HA", str(handicap)))
    props += [("KM", komi if handicap else f"{komi}.5"), ("RE", named_result(result)), ("DT", f"{date[:4]}-{date[4:6]}-{date[6:8]}"), ("PC", site), ("GC", title), ("C", f"{count} moves"), ("SZ", str(size))]
    if stones(handicap, NGF_CORNERS):
        props += [("AB", stones(handicap, NGF_CORNERS)), ("PL", "W")]
    moves = []
    for line in lines[12:]:
        if not line.strip():
            continue
        m = re.match(r"PM([A-Z])(.)([BW])(.)(.)\5\4\s*\Z", line)
        if not m:
            raise ValueError(f"not a move: {line!r}")
        nr = len(moves) + 1
        if (ord(m[1]) - 65) * 26 + ord(m[2]) - 65 != nr:
            raise ValueError(f"move {nr} is numbered {m[1]}{m[2]}")
        x, y = ord(m[4]) - 66, ord(m[5]) - 66
        if (x, y) != (-1, -1) and not (0 <= x < size and 0 <= y < size):
            raise ValueError(f"move {nr} is off the board")
        moves.append((m[3], "" if x < 0 else chr(97 + x) + chr(97 + y)))
    return record(props, moves)


def named_result(text: str) -> str:
    """B+R, W+3.5, W+T and the like from a phrase in Japanese, Chinese or English; else the phrase."""
    low = text.strip().lower()
    side = "B" if re.match("black|黒|黑", low) else "W" if re.match("white|白", low) else ""
    n = re.search(r"\d+(\.\d+)?", low)
    if not side:
        return text
    if re.search(f"resign|{RESIGN_WORDS}|中", low):
        return f"{side}+R"
    if re.search("time|時間|超时", low):
        return f"{side}+T"
    half = ".5" if n and re.search("目半", low) and "." not in n[0] else ""
    return f"{side}+{n[0]}{half}" if n else f"{side}+"


def nip(text: str) -> str:
    """key=value; lines; each p= line holds a position and the move that led to it."""
    lines = [x.strip().rstrip(";") for x in text.splitlines() if x.strip()]
    if not lines or lines[0] != "NIP100":
        raise ValueError("no NIP100 at the start")
    head: dict[str, str] = {}
    moves: list[str] = []
    for line in lines[1:]:
        if line == "END":
            break
        key, eq, value = line.partition("=")
        if not eq:
            raise ValueError(f"no '=' in {line!r}")
        if key == "p":
            if len(value) != 363:
                raise ValueError("a position that isn't 361 points and a move")
            moves.append(value[361:])
        elif key not in ("h1", "h2"):
            if key in head:
                raise ValueError(f"{key} twice")
            head[key] = value
    color, _, score = head.get("Result", "").partition(":")
    if color not in ("1", "2"):
        raise ValueError("no result")
    result = ("B+" if color == "1" else "W+") + ("R" if not score else "T" if score == "t" else f"{score}.5")
    start, end, aired = (head.get(k, "").replace("/", "-") for k in ("Start", "End", "OnAir"))
    date = start if start == end or not end else f"{start}..{end}" if start else end
    props = [("EV", head.get("Title", "")), ("RO", head.get("Stage", "")), ("PB", head.get("Player1", "")), ("PW", head.get("Player2", "")), ("KM", "6.5"), ("RE", result), ("DT", date), ("GC", f"Broadcast {aired}" if aired else "")]
    return record(props, [("BW"[i % 2], mv) for i, mv in enumerate(moves)])


def gib(text: str) -> str:
    r"""A header between \HS and \HE, moves between \GS and \GE."""
    m = re.search(r"^\\HS\s*$(.*?)^\\HE\s*$.*?^\\GS\s*$(.*?)^\\GE\s*$", text, re.S | re.M)
    if not m:
        raise ValueError("no header or no moves")
    head = dict(re.findall(r"\\\[(\w+)=(.*?)\\\]", m[1], re.S))
    lines = [x.strip() for x in m[2].splitlines() if x.strip()]
    if lines[0] not in ("2 1 0", "2 6 0"):
        raise ValueError(f"the moves begin with {lines[0]!r}")
    ini = re.fullmatch(r"INI 0 1 (\d) *&4 *(.*)", lines[2])
    if not ini or ini[1] == "1":
        raise ValueError(f"INI expected, not {lines[2]!r}")
    handicap, moves, color = int(ini[1]), [], "B"
    color = "W" if handicap else "B"
    for line in lines[3:]:
        if s := re.fullmatch(r"STO 0 (\d+) ([12]) (\d+) (\d+)", line):
            if int(s[3]) >= 19 or int(s[4]) >= 19:
                raise ValueError(f"off the board: {line!r}")
            color = "BW"[int(s[2]) - 1]
            moves.append((color, chr(97 + int(s[3])) + chr(97 + int(s[4]))))
        elif re.fullmatch(r"SKI 0 \d+.*", line):
            moves.append((color, ""))  # who passes isn't said: it is whose turn it is
        elif not re.match(r"(IDX|REM) 0 \d+", line):
            raise ValueError(f"not a move: {line!r}")
        color = "W" if color == "B" else "B"
    date = head.get("GAMEDATE", "")
    if d := re.match(r"(\d{4})-\s*(\d+)-\s*(\d+)(?:-\s*(下午|上午)?\s*(\d+)[:-]\s*(\d+)(?:[:-]\s*(\d+))?)?\s*\Z", date):
        hour = int(d[5]) + 12 * (d[4] == "下午") if d[5] else None
        date = f"{d[1]}-{int(d[2]):02d}-{int(d[3]):02d}" + (f" {hour:02d}:{int(d[6]):02d}" if hour is not None else "") + (f":{int(d[7]):02d}" if d[7] else "")
    props: list = [("FF", "3"), ("GM", "1"), ("SZ", "19"), ("PB", head.get("GAMEBLACKNAME", "")), ("PW", head.get("GAMEWHITENAME", "")), ("PC", head.get("GAMEPLACE", "")), ("DT", date), ("RE", named_result(head.get("GAMERESULT", ""))), ("GN", head.get("GAMENAME", "")), ("C", ini[2])]
    if handicap:
        props += [("HA", str(handicap)), ("AB", stones(handicap))]
    return record(props, moves)


def ugi(text: str, cumulative_times: bool = False) -> str:
    """Sections in brackets: Header with key=value, Data with moves 'PP,B1,1,0', Figure and Comment with texts."""
    sections: dict[str, list[str]] = {}
    now = ""
    for line in text.splitlines():
        if m := re.fullmatch(r"\[(\w+)\]\s*", line):
            now = m[1]
            sections.setdefault(now, [])
        else:
            sections.setdefault(now, []).append(line)
    head = dict(x.split("=", 1) for x in sections.get("Header", []) if "=" in x)
    size = int(head.get("Size", "19").split(",")[0] or 19)
    flip = head.get("CoordinateType", "").startswith("IGS")
    setup: dict[str, list[str]] = {"AB": [], "AW": []}
    moves: list[tuple[str, str, str]] = []

    def point(a: str, b: str) -> str:
        row = size - 1 - (ord(b) - 97) if flip else ord(b) - 97
        if not (0 <= row < size and 0 <= ord(a) - 97 < size):
            raise ValueError(f"off the board: {a}{b}")
        return a + chr(97 + row)

    spent = {"B": 0, "W": 0}
    for line in sections.get("Data", []):
        if not line.strip() or line.startswith(" .Text"):
            continue
        if line.startswith(".EndFig"):
            break
        m = re.fullmatch(r"([A-Z])([A-Z]),(?:([BW])(\d)|MK),(\d+),(\d+)\s*(?:'(\d\d):(\d\d):(\d\d))?\s*", line)
        if not m:
            raise ValueError(f"not a move: {line!r}")
        color = m[3] or "BW"[len(moves) % 2]
        mv = "" if m[1] in "YZ" else point(m[1].lower(), m[2].lower())
        if m[5] == "0":
            setup["A" + color].append(mv)
            continue
        spent[color] += int(m[6])
        moves.append((color, mv, f"C[{spent[color]}]" if cumulative_times and spent[color] else ""))
    notes: dict[int, list[str]] = {}
    for name in ("Figure", "Comment"):
        nr = 0
        for line in sections.get(name, []):
            if m := re.match(r"\.(?:Fig|Text),(\d+)", line):
                nr = int(m[1])
            elif not line.startswith(".") and line.strip():
                notes.setdefault(nr, []).append(line.strip())
    two = lambda key: (head.get(key, "").split(",") + ["", ""])[:2]
    (pb, br), (pw, wr) = two("PlayerB"), two("PlayerW")
    ha, km = two("Hdcp")
    win = head.get("Winner", "").split(",")
    result = f"{win[0]}+{'R' if len(win) > 1 and win[1] in ('C', 'R') else win[1] if len(win) > 1 else ''}" if win[0] in ("B", "W") else ""
    props: list = [("GM", "1"), ("SZ", str(size)), ("EV", head.get("Title", "").split(",")[0]), ("PB", pb), ("BR", br), ("PW", pw), ("WR", wr), ("DT", head.get("Date", "").replace("/", "-").split(",")[0]), ("PC", head.get("Place", "")), ("HA", ha if ha not in ("", "0") else ""), ("KM", km), ("RE", result), ("AB", setup["AB"]), ("AW", setup["AW"]), ("C", "\n".join(notes.get(0, [])))]
    body = [(c, f"{mv}]{extra and extra[:-1]}" if extra else mv) for c, mv, extra in moves]
    body = [(c, mv + (f"]C[{escape(chr(10).join(notes[i]))}" if i in notes else "")) for i, (c, mv) in enumerate(body, 1)]
    return record(props, body)


def nihon_kiin(text: str) -> str:
    """A record with other names of properties."""
    from .writer import serialised

    out = []
    for game in parse(text):
        if game["parse_error"]:
            raise ValueError(game["parse_error"])
        for n in game["nodes"]:
            n["props"] = [{"id": RENAMED.get(p["id"], p["id"]), "vals": p["vals"]} for p in n["props"]]
        out.append(serialised(game["nodes"]))
    return "".join(out)


FORMATS = {"ngf": (ngf, "cp932"), "nip": (nip, "utf-8"), "gib": (gib, "utf-8"), "ugi": (ugi, "cp932"), "ugf": (ugi, "cp932"), "nk": (nihon_kiin, "cp932")}


def converted(files: DataFrame, kind: str, charset: str | None = None) -> DataFrame:
    """path, text (a record), error of each file of that format."""
    convert, usual = FORMATS[kind]
    shape = arrow_type(CONVERTED)

    def one(data: bytes | None) -> dict:
        try:
            return {"text": convert((data or b"").decode(charset or usual, "replace")), "error": None}
        except (ValueError, IndexError, KeyError) as e:
            return {"text": None, "error": str(e)}

    @F.arrow_udf(CONVERTED)
    def udf(a: pa.Array) -> pa.Array:
        return pa.array([one(x) for x in a.to_pylist()], shape)

    return files.select("path", udf(F.col("content")).alias("c")).select("path", "c.text", "c.error")
