"""Best-fit packing with certified bin counts.

Pieces are dealt at random to packing partitions. Each packs its own by best-fit
decreasing and compares its number of sequences with lower bounds from dual-feasible
functions over the piece lengths. Where the two are equal, the packing is certified: no
other uses fewer sequences for these pieces. Partitions with a gap put the pieces of
their sequences that aren't full into a pool, deal them out anew, and run best-fit
decreasing again, in an order that is drawn anew within each turn (a piece may be placed as
if it were up to an eighth longer); a new packing counts only if it uses fewer sequences.
Turns go on until two in a row save nothing. Every piece comes with the number of sequences
of the partition that packed it last and the bound for it, so the certificate can be checked.

A text longer than ``size`` is cut into pieces of ``size`` tokens, the first of them
shorter where its length is no multiple. A full piece is a sequence by itself, certified, and
is never moved. Null text counts as empty and is a piece of the end id alone; repeated rows
are packed each; an empty table gives an empty result; very long texts are encoded whole;
other columns are ignored. Ties: the longer piece first, then the one read first. Ids of
documents may be of any type.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, slices
from .encode import encoder

#: Pieces for each packing partition, about: 16 bytes a piece in one task.
DEAL = 50_000
#: Orders that a partition tries in a turn after the first, while its bound isn't met.
TRIES = 4
#: Pieces of text that a worker keeps, bytes of text that it encodes together, and rows that come to it at once.
KEPT, PART, ROWS = 800_000, 4 << 20, 1000
PIECES = "uid long, doc_id {}, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, bins long, bound long, full boolean"


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % size or size
    return [(0, min(first, n))] + [(i, size) for i in range(first, n, size)]


def best_fit_decreasing(lengths: np.ndarray, size: int, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each length its bin and its place there. Ties: the longer first, then the earlier.
    rank: what to go by in place of the lengths."""
    order = np.argsort(-(lengths if rank is None else rank), kind="stable")
    bins, places = np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8")
    open_by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, n = 0, 0  # rooms: bit r is set where a bin with r free tokens is open
    for i, x in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
        else:
            room, b, n = size, n, n + 1
        bins[i], places[i] = b, size - room
        if room > x:
            if not open_by_room[room - x]:
                rooms |= 1 << (room - x)
            open_by_room[room - x].append(b)
    return bins, places


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Bins that any packing needs: the best of two families of dual-feasible functions."""
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=size + 1)[: size + 1].astype("i8")
    x = np.arange(size + 1, dtype="i8")
    best = -(-int((n * x).sum()) // size)
    for k in range(1, size // 2 + 1):
        # lengths over size - k count as a whole bin, those under k as nothing
        u = np.where(x > size - k, size, np.where(x < k, 0, x))
        best = max(best, -(-int((n * u).sum()) // size))
    for k in range(1, 101):
        # round to k-ths of a bin: x stays where (k + 1) x is a whole number of bins
        whole = (k + 1) * x % size == 0
        u = np.where(whole, x * k, (k + 1) * x // size * size)
        best = max(best, -(-int((n * u).sum()) // (size * k)))
    return best


def cut_documents(docs: DataFrame, path: str, end_id: int, size: int, kept: int = KEPT, part_size: int = PART) -> DataFrame:
    """One row for each piece; uid tells apart the pieces of all rows."""

    def apply(batches):
        at = TaskContext.get().partitionId() << 40
        for part, texts in slices(batches, "text", part_size):
            rows = []
            for key, ids in zip(part.column("doc_id").to_pylist(), encoder(path, kept).ids(texts), strict=True):
                raw = memoryview(np.append(ids, np.uint32(end_id)).astype("<u4").tobytes())
                for k, (a, n) in enumerate(cuts(len(raw) // 4, size)):
                    rows.append((at, key, k, a, n, zlib.crc32(raw[4 * a : 4 * (a + n)])))
                    at += 1
            kinds = (pa.int64(), part.column("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(apply, PIECES.format(docs.schema["doc_id"].dataType.simpleString()))


def _packed(pieces: DataFrame, parts: int, turn: int, size: int) -> DataFrame:
    def apply(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("uid", ignore_index=True)
        lengths = group["length"].to_numpy()
        bound = lower_bound(lengths, size)
        bins, places = best_fit_decreasing(lengths, size)
        draw = np.random.default_rng([turn, int(key[0])])
        for _ in range(TRIES if turn else 0):
            if bins.max() + 1 == bound:
                break
            again = best_fit_decreasing(lengths, size, lengths * (1 + draw.random(len(lengths)) / 8))
            if again[0].max() < bins.max():
                bins, places = again
        filled = np.bincount(bins, weights=lengths)
        return group[["uid", "doc_id", "piece", "start", "length", "ids_crc32"]].assign(
            sequence_id=(turn << 50) + (int(key[0]) << 24) + bins, offset=places, bins=len(filled), bound=bound, full=filled[bins] == size
        )

    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(parts)))
    return dealt.groupBy("deal").applyInPandas(apply, PACKED.format(pieces.schema["doc_id"].dataType.simpleString()))


def pack(docs: DataFrame, path: str, end_id: int, size: int = 1024, deal: int = DEAL, kept: int = KEPT, part_size: int = PART) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece, and bins and
    bound of the partition that packed it: certified where they are equal. kept, part_size:
    pieces of text that a worker keeps, bytes that it encodes together; they cost time and
    change no result."""
    pieces = saved(cut_documents(docs, path, end_id, size, kept, part_size), "pieces", rows=ROWS)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bins", "bound", (F.col("bins") == F.col("bound")).alias("certified")]
    full = pieces.where(F.col("length") == size).selectExpr("*", "-1 - uid as sequence_id", "0L as offset", "1L as bins", "1L as bound").select(columns)
    pool = pieces.where(F.col("length") < size)
    n = pool.count()
    if not n:
        return full
    loose, head = (F.col("bins") > F.col("bound")) & ~F.col("full"), F.col("offset") == 0
    best = saved(_packed(pool, max(1, -(-n // deal)), 0, size), "packed")
    out, turn, idle = [full], 0, 0
    while True:
        left = best.agg(F.count_if(loose).alias("pieces"), F.count_if(loose & head).alias("bins")).first()
        if not left["pieces"] or idle == 2:
            out.append(best.select(columns))
            break
        turn += 1
        now = saved(_packed(best.where(loose).select(*pieces.columns), max(1, -(-left["pieces"] // deal)), turn, size), "packed")
        if now.where(head).count() < left["bins"]:
            out.append(best.where(~loose).select(columns))
            best, idle = now, 0
        else:
            idle += 1
            discard(now)
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole
