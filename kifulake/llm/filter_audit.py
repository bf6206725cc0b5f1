"""Filter interaction audit: what each filter removes in every order that they can run in.

A document's failures are a mask, a bit a filter. Histograms of the masks (of all documents,
of the good ones, of the toxic ones) are stacked as rows, a part's three one below the other;
multiplied by integer matrices of 2^filters rows and a column for each order and step (32 by
600 for five filters) they give what every step keeps, removes, finds removed already, and
removes alone. A part is as many numbers as there are masks, however many documents it has.

Null text counts as empty, null language as ''. Documents without an id have none before or
after them; of rows with equal ids none is the smaller. A document is good or toxic if any of
its rows of labels says so; labels without an id say nothing. Repeated rows are counted each; an empty table gives no part.
Columns other than the four named are ignored, whatever their names. Very long texts are
taken whole.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, text_of

FILTERS = "ABCDE"
#: Parts that are multiplied at once.
STACK = 64
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: too few words, too few different ones, too many capitals, a symbol."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    few = F.transform(F.array(sizes), lambda s: F.when(s["n"] < 100, 1).otherwise(0) + F.when(100 * s["d"].cast("long") < 80 * s["n"].cast("long"), 2).otherwise(0))[0]
    capitals = 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text).cast("long")
    return few + F.when(capitals, 4).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def failures(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask, good, toxic of every document. Bit 4: a document of a smaller id has the
    same text; texts are compared by their SHA-256, so that none is shuffled."""
    plain = docs.select(docs[doc_id].alias("id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), text_of(docs, text).alias("text"))
    own = saved(plain.select("id", "part", text_mask(F.col("text")).alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")), "masks")
    first = own.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first")
    marked = own.join(first, "digest", "left").withColumn("mask", F.col("mask") + F.when(F.col("id") > F.col("first"), 16).otherwise(0))
    said = labels.select(labels[doc_id].alias("id"), (labels["quality"] == 1).alias("good"), (labels["toxic"] == 1).alias("toxic"))
    said = said.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("long").alias(c)
    return marked.join(said, "id", "left").select("part", "mask", flag("good"), flag("toxic"))


@lru_cache(4)
def matrices(filters: str = FILTERS) -> tuple[list[tuple[str, int]], np.ndarray, dict[str, np.ndarray]]:
    """The (order, step) of each column, the number of its filter, and the four matrices."""
    columns = [(order, step) for order in permutations(range(len(filters))) for step in range(1, len(filters) + 1)]
    own = np.array([order[step - 1] for order, step in columns])
    bit = 1 << own
    before = np.array([sum(1 << i for i in order[: step - 1]) for order, step in columns])
    mask = np.arange(1 << len(filters))[:, None]
    fails, gone = (mask & bit) != 0, (mask & before) != 0
    every = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask == bit}
    return [("".join(filters[i] for i in order), step) for order, step in columns], own, {k: v.astype("i8") for k, v in every.items()}


def outcomes(stacked: np.ndarray, filters: str = FILTERS) -> dict[str, np.ndarray]:
    """COUNTS for each part and column; stacked: the parts' histograms of all, good and toxic documents."""
    _, own, by = matrices(filters)
    kept, removed, redundant, unique = (stacked @ by[k] for k in ("kept", "removed", "redundant", "unique_fails"))
    total = np.stack([removed[0::3][:, own == f].sum(axis=1) for f in range(len(filters))], axis=1)
    return dict(zip(COUNTS, (kept[0::3], removed[0::3], redundant[0::3], unique[0::3], removed[1::3], removed[2::3], total[:, own]), strict=True))


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order and step, of rows as ``failures`` gives them."""
    size = 1 << len(filters)

    def multiply(batches):
        columns, _, _ = matrices(filters)
        orders, steps = pa.array([o for o, _ in columns]), pa.array([s for _, s in columns], pa.int32())
        for batch in batches:
            for at in range(0, batch.num_rows, STACK):
                rows = batch.slice(at, STACK).to_pylist()
                stacked = np.zeros((3 * len(rows), size), "i8")
                for i, row in enumerate(rows):
                    for x in row["bins"]:
                        stacked[3 * i : 3 * i + 3, x["mask"]] = x["n"], x["good"], x["toxic"]
                for i, found in enumerate(zip(*outcomes(stacked, filters).values(), strict=True)):
                    yield pa.RecordBatch.from_arrays([pa.array([rows[i]["part"]] * len(columns), pa.string()), orders, steps, *map(pa.array, found)], ["part", "filter_order", "step", *COUNTS])

    bins = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    of = bins.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("bins"))  # as many as there are masks
    return of.mapInArrow(multiply, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
