"""The selection algebra: intervals and string tests that become Column predicates.

A null value (a property that isn't there) fails every test but ``absent``; that is what
SQL's three-valued logic does in a filter, so the tests are plain expressions that
Catalyst can push into a scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Interval:
    """Inclusive at both ends; None: open."""

    low: int | None = None
    high: int | None = None

    @classmethod
    def parse(cls, text: str) -> Interval:
        """'5', '5-', '-5', '3-7' or '-'."""
        m = re.fullmatch(r"(\d*)(-?)(\d*)", text)
        if not m or not text:
            raise ValueError(f"not an interval: {text!r}")
        low = int(m[1]) if m[1] else None
        high = (int(m[3]) if m[3] else None) if m[2] else low
        if low is not None and high is not None and high < low:
            raise ValueError(f"empty interval: {text!r}")
        return cls(low, high)

    def test(self, c: Column) -> Column:
        parts = [c.isNotNull()]
        if self.low is not None:
            parts.append(c >= self.low)
        if self.high is not None:
            parts.append(c <= self.high)
        return conjunction(parts)


#: Operators by their spelling, longest first where one begins another.
TESTS = {
    "!=": lambda c, v: c != v,
    "!:": lambda c, v: ~c.contains(v),
    "!": lambda c, v: c.isNull(),
    "=": lambda c, v: c == v,
    ":": lambda c, v: c.contains(v),
}


def string_test(c: Column, op: str, value: str = "") -> Column:
    if op not in TESTS:
        raise ValueError(f"no such test: {op!r}")
    return TESTS[op](c, value)


def conjunction(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def split_test(text: str) -> tuple[str, str, str]:
    """('DT', ':', '2003') of 'DT:2003': name, operator, value, cut at the first operator."""
    m = re.match(r"([^=:!]*)(!=|!:|!|=|:)(.*)\Z", text, re.S)
    if not m:
        raise ValueError(f"no operator in {text!r}")
    return m[1], m[2], m[3]
