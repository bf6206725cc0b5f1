"""Token counts: a broadcast tier of frequent pieces, worker caches for the rest.

No piece is ever shuffled. A first pass keeps, in each partition, a bounded summary of
the most frequent pieces (Misra-Gries counters); the summaries merge 32 at a time, so
no task gets more than 32 of them and the driver one. The winners' token counts, at
most ``hot`` of them, are broadcast; whatever they miss a worker encodes once and keeps
in a bounded cache. The tiers decide speed alone: every count equals the library's.

Ties between pieces change the tiers, not the counts. Very long texts are taken whole.
Null text counts as empty (0 tokens, 0 bytes); repeated rows are counted each; an empty
table gives an empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices
from .encode import PieceEncoder, encoder

#: Characters above which a piece is never kept in the broadcast tier.
LONGEST = 32
_workers: dict = {}


def _pruned(found: Counter, most: int) -> Counter:
    """The Misra-Gries step: take the (most+1)th count off all, drop what is left with none."""
    if len(found) <= most:
        return found
    counts = np.fromiter(found.values(), "i8", len(found))
    off = int(np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1])
    return Counter({k: n - off for k, n in found.items() if n > off})


def frequent_pieces(docs: DataFrame, path: str, hot: int = 20_000, text: str = "text") -> dict[str, int]:
    """At most ``hot`` pieces that all of the text holds most often, and their token counts."""

    def count(batches):
        cut, found = encoder(path)._cut, Counter()
        for _, texts in slices(batches, text, 4 << 20):
            joined = "\x00".join(x for x in map(cut, texts) if x)
            both = pc.value_counts(pc.split_pattern(pa.array([joined], pa.large_string()), "\x00").flatten())
            names, counts = both.field(0), both.field(1)
            # within a slice, what occurs once can't be told from noise and is left to the caches
            keep = pc.and_(pc.greater(counts, 1), pc.less_equal(pc.utf8_length(names), LONGEST))
            for k, n in zip(names.filter(keep).to_pylist(), counts.filter(keep).to_pylist(), strict=True):
                found[k] += n
            if len(found) > 8 * hot:
                found = _pruned(found, 4 * hot)
        yield _summary(TaskContext.get().partitionId(), _pruned(found, hot))

    def merge(key, tables):
        found = Counter()
        for batch in [tables] if isinstance(tables, pa.Table) else tables:
            for row in batch.to_pylist():
                found.update(dict(zip(row["pieces"], row["counts"], strict=True)))
        return pa.Table.from_batches([_summary(key[0].as_py() // 32, _pruned(found, hot))])

    parts = docs.select(text)
    shape = "bucket long, pieces array<string>, counts array<long>"
    left, tree = parts.rdd.getNumPartitions(), parts.mapInArrow(count, shape)
    while left > 1:
        tree = tree.selectExpr("bucket div 32 * 32 as bucket", "pieces", "counts").groupBy("bucket").applyInArrow(merge, shape)
        left = -(-left // 32)
    names = [x for row in tree.collect() for x in row.pieces]  # one summary at most
    return dict(zip(names, PieceEncoder(path, known={}).lengths(names).tolist(), strict=True)) if names else {}


def _summary(bucket: int, found: Counter) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((bucket, list(found), list(found.values())), kinds, strict=True)], ["bucket", "pieces", "counts"])


def count_tokens(docs: DataFrame, path: str, limit: int = 512, hot: int = 20_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of every row; path: the tokenizer's file, on every worker."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_pieces(docs, path, hot, text))

    def apply(batches):
        if shared.value is not _workers.get("known"):
            _workers.update(known=shared.value, encoder=PieceEncoder(path, known=shared.value))
        for part, texts in slices(batches, text, 4 << 20):
            n = _workers["encoder"].lengths(texts)
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(key), size, pa.array(n, pa.int64()), pa.array(n > limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(apply, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
