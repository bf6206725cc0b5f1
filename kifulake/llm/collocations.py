r"""Phrase collocations: sketches say which phrases can be frequent, automata count them.

Texts are lower-cased (A-Z alone) and cut into pieces at [.,;:!?\x0A-\x0D], pieces into words
[^\x20\x09]+. Three passes over the texts, all of bounded memory:

1. A count-min sketch of words and pairs, two rows of saturating counters. A task sends what
   it has counted in blocks of buckets, so the sketch is summed block by block, and of each
   bucket one bit stays: whether its phrases can reach the threshold.
2. The same of the longer phrases all of whose pairs can.
3. Chunk by chunk the phrases that pass all their bits (upper bounds: none that is frequent
   can fail) are compiled into an Aho-Corasick automaton, blanks around each, and the chunk
   is scanned for all overlapping matches. A task sends its counts in shards by the phrase's
   hash, a list a shard; each shard is summed by itself, and the threshold then holds exactly.
   Shards are as many more as the corpus is larger, so what one holds stays alike.

The sketch's width follows the corpus up to ``Sizes.most`` buckets a row (the bits that are
broadcast are 32 MB a row and pass then); a corpus beyond that has more candidates to
count, never other results. Phrases of one chunk are told apart by 64-bit numbers. A chunk
is a megabyte; a longer text is cut where a word ends, the words before the cut being read
again for the phrases that go over it.

Null text counts as empty, null language as 'und'. Repeated rows count each. An empty table
gives an empty result. Other columns are ignored, whatever their names. Equal scores and
counts are ranked by the phrase's bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, saved, small, text_of
from .words import _BYTE, _window, mix

LEAST, LONGEST, FIRST = 100, 5, 2_000
ROWS = 2
#: Lower case, marks between pieces as line feeds, tabs as blanks.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")


@dataclass(frozen=True)
class Sizes:
    """What bounds memory; no result depends on it. per_bucket: bytes of text to a bucket of
    the sketch; fewest, most: bounds of a row's buckets; block: buckets that are summed
    together; chunk: bytes of text; kept, phrases: what a task holds before it sends them; shards: lists
    that it sends at least."""

    per_bucket: int = 128
    fewest: int = 1 << 20
    most: int = 1 << 28
    block: int = 1 << 18
    chunk: int = 1 << 20
    kept: int = 4 << 20
    phrases: int = 300_000
    shards: int = 64

    def width(self, size: int) -> int:
        return min(max(self.fewest, 1 << (size // self.per_bucket).bit_length()), self.most)


SIZES = Sizes()
_ODD = np.uint64(0x9E3779B97F4A7C15)


def plain(text: bytes) -> bytes:
    """Words with a blank before and after each, a line feed standing as a word between pieces."""
    out = (b" " + text.translate(PLAIN).replace(b"\n", b" \n ") + b" ") if text else b" "
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out


def chunks(batches: Iterator[pa.RecordBatch], longest: int, size: int) -> Iterator[tuple[str, bytes, int]]:
    """(language, plain text, how many of its words were in the chunk before it)."""
    for part in parts(batches, "text", size):
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            text, at, again, stop = plain(b"\n".join(texts)), 0, 0, 0
            while True:
                stop = text.find(b" ", max(at + 2 * size, stop + 1))
                if stop < 0:
                    yield lang, text[at:], again
                    break
                yield lang, text[at : stop + 1], again
                back = stop
                for _ in range(longest - 1):
                    back = max(text.rfind(b" ", 0, back), 0)
                again = sum(w != b"\n" for w in text[back:stop].split(b" ") if w)
                at = back


class Chunk:
    """The words of a plain text: places, and the numbers of all phrases that begin at each."""

    def __init__(self, lang: str, text: bytes, again: int, longest: int):
        data = np.frombuffer(text, "u1")
        own, self.starts = _window(data, np.zeros(1, "i8"), _BYTE)
        self.text, self.again = text, again
        inside = (data != 32) & (data != 10)
        self.ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1 if len(data) > 1 else np.zeros(0, "i8")
        piece = np.cumsum(data == 10)[self.starts]
        first = mix(own ^ np.uint64(zlib.crc32(lang.encode())))
        n = len(first)
        self.grams, self.within = [first], [np.ones(n, bool)]
        for k in range(2, longest + 1):
            size = max(0, n - k + 1)
            self.grams.append(mix(self.grams[-1][:size] * _ODD + first[k - 1 :][:size]))
            self.within.append(piece[k - 1 :][:size] == piece[:size])
        for k, ok in enumerate(self.within, 1):
            ok[: max(0, again - k + 1)] = False  # ends before what is new here

    def __len__(self) -> int:
        return len(self.starts) - self.again


def buckets(numbers: np.ndarray, row: int, width: int) -> np.ndarray:
    return ((numbers >> np.uint64(32 * row)) & np.uint64(width - 1)).astype("u4")


def able(bits: dict, level: int, numbers: np.ndarray, width: int) -> np.ndarray:
    """Whether each phrase's buckets all reach the threshold."""
    out = np.ones(len(numbers), bool)
    for row in range(ROWS):
        b = buckets(numbers, row, width)
        out &= (bits[level, row][b >> 3] >> (b & 7).astype("u1") & 1).astype(bool)
    return out


def chained(pairs: np.ndarray, k: int) -> np.ndarray:
    """Of marks of pairs, whether the k - 1 pairs from each word on are all marked."""
    n = max(0, len(pairs) - k + 2)
    out = pairs[:n].copy()
    for i in range(1, k - 1):
        out &= pairs[i : i + n]
    return out


def packed(found: np.ndarray, cap: int, block: int) -> Iterator[tuple[int, int, bytes]]:
    """(block, buckets, compressed bytes) of the buckets that occurred and how often: steps
    from one to the next, byte by byte of all (the upper ones are mostly 0), then counters."""
    at, n = np.unique(found, return_counts=True)
    n = np.minimum(n, cap).astype("u2")
    cuts = np.flatnonzero(np.diff(at.astype("i8") // block, prepend=-1, append=-1)) if len(at) else []
    for a, b in pairwise(cuts):
        steps = np.diff(at[a:b] % block, prepend=np.zeros(1, at.dtype)).astype("<u4")
        planes = np.concatenate([steps.view("u1").reshape(-1, 4).T.ravel(), n[a:b].view("u1").reshape(-1, 2).T.ravel()])
        yield int(at[a]) // block, b - a, pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def counters(size: int, data: bytes, block: int) -> np.ndarray:
    """The counters of a block again."""
    planes, out = np.frombuffer(pa.decompress(data, 6 * size, codec="zstd", asbytes=True), "u1"), np.zeros(block, "u2")
    steps = np.ascontiguousarray(planes[: 4 * size].reshape(4, -1).T).view("<u4").ravel()
    out[np.cumsum(steps)] = np.ascontiguousarray(planes[4 * size :].reshape(2, -1).T).view("<u2").ravel()
    return out


def sketch(texts: DataFrame, levels: tuple[int, ...], width: int, least: int, known, sizes: Sizes) -> DataFrame:
    """level, line, block, bits: a bit a bucket, of the blocks in which a phrase can be frequent.
    known: the broadcast bits of shorter phrases, of which longer ones consist; None: take all."""
    cap = min(least, 65_535)

    def count(batches):
        bits, longest = known and known.value, max(levels)
        kept, size = {level: [] for level in levels}, 0

        def sent():
            out = [(level, row, *x) for level in levels if kept[level] for every in [np.concatenate(kept[level])] for row in range(ROWS) for x in packed(buckets(every, row, width), cap, sizes.block)]
            for at in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 64], strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["level", "line", "block", "size", "data"])

        for chunk in (Chunk(*x, longest) for x in chunks(batches, longest, sizes.chunk)):
            pairs = able(bits, 2, chunk.grams[1], width) if bits else None
            for level in levels:
                ok = chunk.within[level - 1]
                if pairs is not None:
                    ok = ok & chained(pairs, level)
                found = chunk.grams[level - 1][ok]
                kept[level].append(found)
                size += len(found)
            if size >= sizes.kept:
                yield from sent()
                kept, size = {level: [] for level in levels}, 0
        yield from sent()

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sizes.block, "u4")
        for batch in batches:
            for size, data in zip(batch.column("size").to_pylist(), batch.column("data").to_pylist(), strict=True):
                total = np.minimum(total + counters(size, data, sizes.block), least)  # never beyond 32 bits
        reached = total >= cap
        if reached.any():
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([key[2].as_py()], pa.int64()), pa.array([np.packbits(reached, bitorder="little").tobytes()], pa.binary())], ["level", "line", "block", "bits"])

    sent = texts.mapInArrow(count, "level int, line int, block long, size int, data binary")
    return sent.groupBy("level", "line", "block").applyInArrow(merge, "level int, line int, block long, bits binary")


def gathered(found: DataFrame, levels: tuple[int, ...], width: int, block: int) -> dict[tuple[int, int], np.ndarray]:
    """The bits of each level and row: width / 8 bytes each, whatever the corpus."""
    out = {(level, row): np.zeros(width // 8, "u1") for level in levels for row in range(ROWS)}
    for x in found.collect():
        out[x.level, x.line][x.block * block // 8 :][: block // 8] = np.frombuffer(x.bits, "u1")
    return out


def matches(chunk: Chunk, candidates: list[np.ndarray]) -> Iterator[tuple[str, int]]:
    """(phrase, occurrences); candidates: for 1, 2 ... words where one begins."""
    phrases = []
    for k, at in enumerate(candidates, 1):
        phrases += [chunk.text[a:b].decode() for a, b in zip(chunk.starts[at].tolist(), chunk.ends[at + k - 1].tolist(), strict=True)]
    if not phrases:
        return
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, p in enumerate(phrases):
        automaton.add_word(f" {p} ", i)
    automaton.make_automaton()
    # the characters up to the blank behind the last word that the chunk before has counted
    known = len(chunk.text[: chunk.ends[chunk.again - 1]].decode()) if chunk.again else 0
    found = np.fromiter((i for end, i in automaton.iter(chunk.text.decode()) if end > known), "i8")
    yield from zip(phrases, np.bincount(found, minlength=len(phrases)).tolist(), strict=True)


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang", sizes: Sizes = SIZES) -> DataFrame:
    """lang, phrase, a: all phrases of up to ``longest`` words that occur ``least`` times or more,
    exactly; the phrase '' counts the words of the language."""
    return candidate_counts(docs, least, longest, text, lang, sizes).where((F.col("a") >= least) | (F.col("phrase") == ""))


def candidate_counts(docs: DataFrame, least: int, longest: int, text: str = "text", lang: str = "lang", sizes: Sizes = SIZES) -> DataFrame:
    """The same of all phrases that pass their bits."""
    texts = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), text_of(docs, text).alias("text"))
    spark = docs.sparkSession
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    width = sizes.width(size)
    short, long = tuple(range(1, min(longest, 2) + 1)), tuple(range(3, longest + 1))
    bits = gathered(sketch(texts, short, width, least, None, sizes), short, width, sizes.block)
    if long:
        shared = spark.sparkContext.broadcast(bits)
        bits |= gathered(sketch(texts, long, width, least, shared, sizes), long, width, sizes.block)
        shared.unpersist()
    every = spark.sparkContext.broadcast(bits)

    def count(batches):
        bits, total = every.value, {}

        def sent():
            by: dict[int, list] = {}
            for key, n in total.items():
                by.setdefault(zlib.crc32("\n".join(key).encode()) % shards, []).append((*key, n))
            for shard, rows in by.items():
                lists = [pa.array([list(c)], pa.list_(t)) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *lists], ["shard", "langs", "phrases", "counts"])

        for lang, text, again in chunks(batches, longest, sizes.chunk):
            chunk = Chunk(lang, text, again, longest)
            total[lang, ""] = total.get((lang, ""), 0) + len(chunk)
            found, ok = [], None
            for k in range(1, longest + 1):
                numbers = chunk.grams[k - 1]
                can = able(bits, k, numbers, width)
                if ok is not None:  # what is frequent begins and ends with frequent phrases of a word less
                    can &= ok[: len(can)] & ok[1 : len(can) + 1]
                ok, at = can, np.flatnonzero(can & chunk.within[k - 1])
                found.append(at[np.unique(numbers[at], return_index=True)[1]])
            for phrase, n in matches(chunk, found):
                total[lang, phrase] = total.get((lang, phrase), 0) + n
            if len(total) > sizes.phrases:
                yield from sent()
                total.clear()
        yield from sent()

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            columns = [batch.column(c).flatten().to_pylist() for c in ("langs", "phrases", "counts")]
            for lang, phrase, n in zip(*columns, strict=True):
                total[lang, phrase] = total.get((lang, phrase), 0) + n
        rows = list(total.items())
        for at in range(0, len(rows), 10_000):
            some = rows[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in some], pa.string()), pa.array([k[1] for k, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], ["lang", "phrase", "a"])

    shards = max(sizes.shards, width // sizes.block)
    sent = texts.mapInArrow(count, "shard long, langs array<string>, phrases array<string>, counts array<long>")
    return sent.groupBy("shard").applyInArrow(add, "lang string, phrase string, a long")


def ranked(counts: DataFrame, first: int = FIRST, spread: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``first`` phrases, of phrase_counts saved."""
    words = F.split("phrase", " ")
    phrases = counts.where("phrase != ''")
    long = phrases.where(F.size(words) >= 2)
    # what lies inside a longer phrase as frequent lies inside one longer by a word that is as frequent
    inner = F.explode(F.array(*[F.array_join(F.slice(words, i, F.size(words) - 1), " ") for i in (1, 2)])).alias("phrase")
    inside = long.where(F.size(words) >= 3).select("lang", inner, F.col("a").alias("over")).groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    own = long.join(inside, ["lang", "phrase"], "left").where("over is null or over < a").drop("over")
    cut = F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k")
    cuts = own.select("*", cut).select("lang", "phrase", "a", "k", F.array_join(F.slice(words, 1, F.col("k")), " ").alias("left"), F.array_join(F.slice(words, F.col("k") + 1, F.size(words)), " ").alias("right"))
    part = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    total = small(counts.where("phrase = ''").select("lang", F.col("a").alias("n")))
    both = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(total, "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    scored = both.withColumns({"over": 1000 * wide("a") * wide("n"), "under": wide("l") * wide("r")}).withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    rows = best.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")
    # a language's phrases go through ``spread`` tasks, each of which keeps the first alone
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = rows.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(spread)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= first)
    at = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return some.withColumn("rank", at).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, text: str = "text", lang: str = "lang", sizes: Sizes = SIZES) -> DataFrame:
    return ranked(saved(phrase_counts(docs, least, longest, text, lang, sizes), "phrases"), first)
