"""Character sets of records: detection, reconciliation with what a record says, conversion.

Spark's decode() knows none of the East Asian sets, so these are Arrow UDFs on bytes,
before a value becomes a string.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.sgf import arrow_type

#: The sets tried, with Python's names; those that hold another come after it.
SETS = {"UTF-8": "utf-8", "EUC-KR": "euc_kr", "GB2312": "gb2312", "GBK": "gbk", "GB18030": "gb18030", "Big5": "big5", "Shift_JIS": "shift_jis", "CP932": "cp932", "ISO-8859-1": "latin-1"}
CONTAINED = {"GBK": ("GB2312",), "GB18030": ("GB2312", "GBK"), "CP932": ("Shift_JIS",)}
ALIASES = {"ks_c_5601": "EUC-KR", "ks_c_5601-1987": "EUC-KR", "sjis": "Shift_JIS", "shift-jis": "Shift_JIS", "ms932": "CP932", "latin1": "ISO-8859-1", "utf8": "UTF-8", "gb": "GB2312"}
#: Sets whose second bytes may be a backslash or a bracket.
DOUBLE = ("GBK", "GB18030", "Big5", "Shift_JIS", "CP932")
FOUND = "struct<charset:string,candidates:array<string>,stated:string,verdict:string>"
STATED = re.compile(rb"\bCA\s*\[\s*([^\]]*?)\s*\]")


def is_ascii(data: bytes) -> bool:
    return all(0x20 <= b <= 0x7E or b in (0x0A, 0x0D) for b in data)


def _score(name: str, text: str) -> float:
    """How much of the text looks like what the set is for: its usual scripts, 0 to 1."""
    wide = [c for c in text if ord(c) > 0x7F]
    if not wide:
        return 1.0
    spans = {
        "EUC-KR": ((0xAC00, 0xD7A3),),
        "Shift_JIS": ((0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xFF10, 0xFF5A)),
        "CP932": ((0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xFF10, 0xFF5A)),
        "ISO-8859-1": ((0xC0, 0xFF),),
    }.get(name, ((0x4E00, 0x9FA5), (0x3000, 0x303F), (0xFF00, 0xFF5E)))
    return sum(any(a <= ord(c) <= b for a, b in spans) for c in wide) / len(wide)


def candidates(data: bytes) -> list[str]:
    """Sets in which the bytes can be read and look like text, the likeliest first."""
    if is_ascii(data):
        return ["ASCII"]
    try:
        text = data.decode("utf-8")
        return ["UTF-8"] if all(ord(c) < 0x10000 for c in text) else []
    except UnicodeDecodeError:
        pass
    scored = []
    for name, codec in list(SETS.items())[1:]:
        try:
            text = data.decode(codec)
        except UnicodeDecodeError:
            continue
        if any(0x80 <= ord(c) <= 0x9F or 0xE000 <= ord(c) <= 0xF8FF for c in text):
            continue
        score = _score(name, text)
        if score >= 0.6:
            scored.append((round(score, 3), name))
    names = {n for _, n in scored}
    scored = [(s, n) for s, n in scored if not any(x in names for x in CONTAINED.get(n, ()))]
    best = max((s for s, _ in scored), default=0)
    return [n for s, n in sorted(scored, key=lambda x: -x[0]) if s >= best - 0.15]


def detect(data: bytes) -> dict:
    """charset (null where several sets are as likely), candidates, what CA[] says, and how the two agree."""
    found = candidates(data)
    m = STATED.search(data)
    stated = m[1].decode("latin-1") if m else None
    name = next((k for k in SETS if stated and k.lower() == stated.lower()), ALIASES.get((stated or "").lower()))
    chosen = found[0] if len(found) == 1 else None
    if stated is None:
        verdict = "unstated"
    elif name is None:
        verdict = "unknown"
    elif found == ["ASCII"]:
        verdict = "ok"
    else:
        try:
            data.decode(SETS[name])
            fits = name in found or any(name in CONTAINED.get(n, ()) or n in CONTAINED.get(name, ()) for n in found)
            verdict = "ok" if fits else "possible" if not found else "wrong"
        except UnicodeDecodeError:
            verdict = "wrong"
        if verdict in ("ok", "possible"):
            chosen = name
    return {"charset": chosen, "candidates": found, "stated": stated, "verdict": verdict}


def to_utf8(data: bytes, source: str | None = None, replace: bool = False) -> bytes | None:
    """The record in UTF-8 with CA[UTF-8]; null where its set can't be told.

    A second byte that is a backslash or bracket may have been escaped as if it stood for
    itself; such escapes go before decoding, and brackets of the text are escaped after it.
    """
    name = source or detect(data)["charset"]
    if name is None:
        return None
    if name in ("ASCII", "UTF-8"):
        text = data.decode("utf-8", "replace" if replace else "strict")
    else:
        if name in DOUBLE:
            data = re.sub(rb"([\x81-\xfe])\\([\\\]])", rb"\1\2", data)
        try:
            text = data.decode(SETS[name], "replace" if replace else "strict")
        except UnicodeDecodeError:
            return None
    if re.search(r"\bCA\s*\[", text):
        text = re.sub(r"\bCA\s*\[[^\]]*\]", "CA[UTF-8]", text, count=1)
    else:
        text = re.sub(r"\(\s*;", lambda m: m[0] + "CA[UTF-8]", text, count=1)
    return text.encode("utf-8")


def detected(content: Column) -> Column:
    shape = arrow_type(FOUND)

    @F.arrow_udf(FOUND)
    def udf(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else detect(x) for x in a.to_pylist()], shape)

    return udf(content)


def converted(content: Column, source: str | None = None, replace: bool = False) -> Column:
    @F.arrow_udf("binary")
    def udf(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else to_utf8(x, source, replace) for x in a.to_pylist()], pa.binary())

    return udf(content)
