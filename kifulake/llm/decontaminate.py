"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case with each run of white space as one blank. An item with
n characters may be found with up to k = floor(n * share) edits. Cut into k + 1 pieces,
at least one piece must occur unchanged; all pieces of all items go into one automaton
that passes over a text once. Around each hit, Myers' bit-parallel algorithm decides
whether the item occurs within k edits, in a window as long as the item and its budget
allow; parts of the item around the piece are tried first, as most hits fail there.

The benchmark is broadcast, so its size is checked first: beyond ``most`` characters the
items are dealt into parts and the texts pass once for each part. Documents are never
shuffled and never cut.

The benchmark's items pass through the driver a part at a time. Ties don't arise: each item
found is reported with its least number of edits, items in no certain order. Very long texts
are searched whole. Null or blank items match nothing; an item too short for a budget (n * share < 1) must
occur unchanged. Null text counts as empty; repeated rows are judged each; items with
equal text are reported each; an empty table on either side gives no matches.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: The edits that an item may be found with, as a share of its characters.
SHARE = 0.1
#: Characters of items in one automaton: some 100 bytes each in a worker.
MOST = 1_000_000
_BLANKS = re.compile(r"\s+")


def plain(text: str) -> str:
    return _BLANKS.sub(" ", text.lower()).strip()


@lru_cache(1 << 14)
def _masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(pattern: str, text: str, most: int) -> int | None:
    """The least number of edits (at most ``most``) that turn the pattern into some part of the text."""
    if pattern in text:
        return 0
    masks, n = _masks(pattern), len(pattern)
    every, high = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = every, 0, n, n
    for c in text:
        eq = masks.get(c, 0)
        x = eq | down
        d = (((x & up) + up) ^ up) | x
        rise, fall = down | ~(d | up), up & d
        if rise & high:
            score += 1
        elif fall & high:
            score -= 1
            best = min(best, score)
        rise = rise << 1  # a match may start anywhere: the first row stays 0
        down, up = rise & d & every, ((fall << 1) | ~(rise | d)) & every
    return best if best <= most else None


class Finder:
    """items: (id, plain text). found(text): (id, edits) of each item that the text holds.

    The pieces of an item are the leaves of a binary tree. If a node with p pieces occurs
    within p - 1 edits, one of its halves, with q pieces, does within q - 1. So where an
    item occurs, some piece occurs unchanged and all nodes above it within their budgets:
    a hit is followed upwards, from short nodes to the item, until one fails.
    """

    def __init__(self, items: list[tuple[int, str]], share: float = SHARE):
        self.items = items
        self.budget = [int(len(t) * share + 1e-9) for _, t in items]
        pieces: dict[str, list[tuple[int, int, tuple]]] = {}
        for i, (_, t) in enumerate(items):
            n = self.budget[i] + 1
            cuts = [len(t) * j // n for j in range(n + 1)]
            for a, b, above in self._leaves(cuts, 0, n, ()):
                pieces.setdefault(t[a:b], []).append((i, a, above))
        self.machine = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.machine.add_word(piece, (len(piece), places))
        self.machine.make_automaton()

    def _leaves(self, cuts: list[int], lo: int, hi: int, above: tuple):
        """(start, end, nodes above from the lowest: start, end, budget) of each piece."""
        if hi - lo == 1:
            yield cuts[lo], cuts[hi], above
            return
        above, middle = ((cuts[lo], cuts[hi], hi - lo - 1), *above), (lo + hi) // 2
        yield from self._leaves(cuts, lo, middle, above)
        yield from self._leaves(cuts, middle, hi, above)

    def found(self, text: str) -> list[tuple[int, int]]:
        text, best = plain(text), {}
        if not len(self.machine):
            return []
        for end, (n, places) in self.machine.iter(text):
            start = end - n + 1
            for i, offset, above in places:
                if best.get(i) == 0:
                    continue
                item, edits = self.items[i][1], 0
                for a, b, most in above:
                    edits = myers(item[a:b], text[max(0, start - offset + a - most) : start - offset + b + most], most)
                    if edits is None:
                        break
                if edits is not None and edits < best.get(i, 1 << 30):
                    best[i] = edits
        return [(self.items[i][0], k) for i, k in best.items()]


@lru_cache(2)
def _finder(items: tuple[tuple[int, str], ...], share: float) -> Finder:
    return Finder(list(items), share)


def _parts(benchmark: DataFrame, most: int) -> list[tuple[tuple[int, str], ...]]:
    """The items in parts of at most so many characters (an item longer than that is a part)."""
    parts, size = [[]], 0
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null")
    for row in items.orderBy("i", "t").toLocalIterator():  # a partition at a time
        text = plain(row.t)
        if not text:
            continue
        if parts[-1] and size + len(text) > most:
            parts.append([])
            size = 0
        parts[-1].append((row.i, text))
        size += len(text)
    return [tuple(p) for p in parts if p]


def _searched(docs: DataFrame, benchmark: DataFrame, share: float, most: int) -> DataFrame:
    """docs (its text column named _text) with _hits: (item_id, edits) of each item found."""
    out = docs.withColumn("_hits", F.expr("cast(array() as array<struct<item_id:bigint,edits:int>>)"))
    shape = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32())]))
    for items in _parts(benchmark, most):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def find(batches, shared=shared):
            finder = _finder(shared.value, share)
            for part, texts in slices(batches, "_text", 4 << 20):
                before = part.column("_hits").to_pylist()
                hits = [old + [{"item_id": i, "edits": k} for i, k in finder.found(t)] for old, t in zip(before, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(hits, shape)], part.schema.names)

        out = out.mapInArrow(find, out.schema)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id and hits, (item_id, edits) of each item found, of every row."""
    return _searched(docs.select("doc_id", docs["text"].cast("string").alias("_text")), benchmark, share, most).select("doc_id", F.col("_hits").alias("hits"))


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows in whose text no item is found, with all columns."""
    plain_names = {n: "_text" if n == "text" else f"c{i}" for i, n in enumerate(docs.columns)}  # nothing added can clash with these
    found = _searched(docs.toDF(*plain_names.values()), benchmark, share, most).where("size(_hits) = 0")
    return found.select(*[F.col(c).alias(n) for n, c in plain_names.items()])
