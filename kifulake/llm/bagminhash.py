"""Near-duplicate documents by BagMinHash: signatures of weighted Jaccard similarity.

A document is the multiset of its five-word shingles (one shingle of all its words where
there are fewer; none where there is no word). Two documents are linked if their weighted
Jaccard similarity, sum of minima over sum of maxima, is at least ``least``; a class is a
connected component of the links, together with all exact copies.

Signatures: a shingle of weight w owns the interval [0, w), cut into blocks [0, 1),
[1, 2), [2, 4), [4, 8) ... that double as the levels of a hierarchy do. Each block is a
Poisson process in time whose points fall on a random register and a random place of the
block; a point counts if its place is under w (the last block is thinned so, rather than
halved further). A register keeps its earliest point, so two multisets agree on a register
with a probability of exactly their weighted Jaccard similarity. Only points up to a time
limit are made, about the same number for any document; where a register stays empty, that
document runs again with twice the limit.

100 registers in 20 bands of 5: a pair at 0.8 shares a band but for one in 2,900, one at 0.85
but for one in 53,000; of pairs at 0.3 one in 20 does, at 0.2 one in 150.

Exact copies collapse first, so a group of a third of all rows is one representative.
The documents of a bucket meet around its first one: all that share a bucket with the same
first document form a star (small as its members are similar to that document; chains of
weakly similar documents are many small stars). A star is dealt at random into blocks of
bounded size, and a task gets two blocks: it computes all their overlaps at once, as
products of shingle-incidence matrices, and returns no more links than connect what it found
to be connected. A small star is one block. Of a star of more than a few blocks, first the
others meet just one block; those that this puts into one class are blocks by themselves,
which needn't meet each other any more. So every pair of a bucket is either verified or in
one class. Documents meet in one star each first; then the other stars do, but for those of
buckets that are one class by then.

Null text counts as empty; texts without a word are copies of each other only if equal.
Repeated rows are copies. A row keeps its place if no row of its class has a smaller
(doc_id, place in the table), a null doc_id last. An empty table gives an empty result.
Very long texts are taken whole. Rows are told apart as ``common.numbered`` says.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST, discard, numbered, parts, saved, small
from .graph import components
from .words import hashes, mix

REGISTERS, ROWS = 100, 5
#: The most documents, and about the most shingles, of a block; blocks beyond which a star is done in two steps.
BLOCK, SHINGLES, FEW = 256, 1_000_000, 6
WORDS = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from the high bits."""
    return ((x >> np.uint64(11)).astype("f8") + 1) / (1 << 53)


def shingles(texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, weight) of each distinct shingle of each text, in order."""
    word, sizes = hashes(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    n = np.where(sizes >= WORDS, sizes - WORDS + 1, np.minimum(sizes, 1))
    of = np.repeat(np.arange(len(texts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(sizes) - sizes, n)
    length = np.minimum(sizes, WORDS)[of]
    key = mix(length.astype("u8") + _ODD)
    for k in range(WORDS):
        use = k < length
        key[use] = mix((key[use] + _ODD) ^ word[at[use] + k])
    order = np.lexsort((key, of))
    of, key = of[order], key[order]
    first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (key[1:] != key[:-1])]) if len(of) else np.zeros(0, "i8")
    return of[first], key[first], np.diff(np.r_[first, len(of)])


def signatures(texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of REGISTERS points for each text (zeros: no word), and its total weight."""
    of, key, weight = shingles(texts)
    total = np.bincount(of, weights=weight, minlength=len(texts))
    out = np.zeros((len(texts), REGISTERS), "u8")
    left, limit = total > 0, np.zeros(len(texts))
    limit[left] = REGISTERS * (np.log(REGISTERS) + 4) / total[left]
    while left.any():
        some = left[of]
        points = _points(of[some], key[some], weight[some], limit)
        owner, register, time, name = points
        slot = owner * REGISTERS + register
        order = np.lexsort((time, slot))
        slot, name = slot[order], name[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, "i8")
        made = np.zeros(len(texts) * REGISTERS, "u8")
        made[slot[first]] = name[first]
        full = np.bincount(slot[first] // REGISTERS, minlength=len(texts)) == REGISTERS
        done = left & full
        out[done] = made.reshape(-1, REGISTERS)[done]
        left &= ~full
        limit[left] *= 2
    return out, total


def _points(of: np.ndarray, key: np.ndarray, weight: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, register, time, name) of each point up to its text's limit."""
    blocks, found = [], []
    start, width, block = 0, 1, 0
    while (inside := weight > start).any():
        blocks.append((of[inside], mix(key[inside] + np.uint64(int(_ODD) * (block + 1) % (1 << 64))), weight[inside], np.full(inside.sum(), start), np.full(inside.sum(), width)))
        start, width, block = start + width, max(1, start + width), block + 1
    owner, seed, w, start, width = (np.concatenate(x) for x in zip(*blocks, strict=True))
    time = np.zeros(len(owner))
    while len(owner):
        seed = mix(seed + _ODD)
        time = time - np.log(unit(seed)) / width
        alive = time <= limit[owner]
        owner, seed, w, start, width, time = (x[alive] for x in (owner, seed, w, start, width, time))
        place = mix(seed ^ np.uint64(0xD1B54A32D192ED03))
        inside = start + unit(place) * width <= w
        register = (mix(place + _ODD) % np.uint64(REGISTERS)).astype("i8")
        found.append((owner[inside], register[inside], time[inside], place[inside] | np.uint64(1)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def similarity(a: str, b: str) -> float:
    """The weighted Jaccard similarity of two texts; 1 where neither has a word and they are equal."""
    of, key, weight = shingles([a, b])
    if not len(of):
        return float(a == b)
    n = int((of == 0).sum())
    both, i, j = np.intersect1d(key[:n], key[n:], assume_unique=True, return_indices=True)
    least = int(np.minimum(weight[:n][i], weight[n:][j]).sum())
    return least / (int(weight.sum()) - least)


def shingle_sets(texts: pa.Array | list[str]) -> list[bytes]:
    """Each text's multiset as a set of sorted numbers: the k-th copy of a shingle is a number of its own."""
    of, key, weight = shingles(texts)
    more = np.repeat(np.arange(len(key)), weight)
    copy = np.arange(len(more)) - np.repeat(np.cumsum(weight) - weight, weight)
    key = np.where(copy > 0, mix(key[more] + copy.astype("u8") * _ODD), key[more])
    ends = np.cumsum(np.bincount(of[more], minlength=len(texts)))
    return [np.sort(key[a:b]).tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def overlaps(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """How many numbers each two of the sets share: a sum of products of incidence matrices."""
    n = len(sets)
    out = np.zeros((n, n), "f4")
    who, every = np.repeat(np.arange(n), [len(x) for x in sets]), np.concatenate(sets) if n else np.zeros(0, "u8")
    order = np.argsort(every, kind="stable")
    who, every = who[order], every[order]
    new = np.r_[True, every[1:] != every[:-1]] if len(every) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    shared = np.bincount(number, minlength=1) > 1
    keep = shared[number] if len(number) else np.zeros(0, bool)
    who, number = who[keep], (np.cumsum(shared) - 1)[number[keep]] if len(number) else number
    cuts = np.searchsorted(number, np.arange(0, int(shared.sum()) + columns, columns))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if b > a:
            m = np.zeros((n, columns), "f4")
            m[who[a:b], number[a:b] - k * columns] = 1
            out += m @ m.T
    return out


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links enough to connect all that the matrix connects."""
    root = list(range(len(linked)))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in np.argwhere(np.triu(linked, 1)).tolist():
        a, b = top(i), top(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _sketches(rows: DataFrame, text: str) -> DataFrame:
    """f, r, weight, keys (one for each band) of each document with a word."""

    def sketch(batches):
        for part in parts(batches, "text"):
            made, total = signatures(part.column("text"))
            bands = made.reshape(part.num_rows, -1, ROWS)
            keys = np.zeros(bands.shape[:2], "u8")
            for k in range(ROWS):
                keys = mix((keys + _ODD) ^ bands[:, :, k])
            keys = mix(keys + np.arange(keys.shape[1], dtype="u8"))
            some = total > 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(some.sum() + 1) * keys.shape[1], pa.int32()), pa.array(keys[some].ravel().view("i8")))
            at = pa.array(np.flatnonzero(some))
            yield pa.RecordBatch.from_arrays([part.column("f").take(at), part.column("r").take(at), pa.array(total[some].astype("i8")), lists], ["f", "r", "weight", "keys"])

    return rows.select("f", "r", F.col(text).cast("string").alias("text")).mapInArrow(sketch, "f long, r long, weight long, keys array<long>")


def _links(members: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(a, b), enough of the links of each two blocks. members: cluster, block, uid, shingles;
    pairs: cluster, i, j, the blocks that meet."""

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        block, uid = group.column("block").to_numpy(), group.column("uid").to_numpy()
        order = np.lexsort((uid, block))
        sets = [np.frombuffer(x.as_py(), "u8") for x in group.column("shingles").take(pa.array(order)).combine_chunks()]
        block, uid = block[order], uid[order]
        size = np.array([len(x) for x in sets], "f4")
        both = overlaps(sets)
        linked = both >= (least - 1e-9) * (size[:, None] + size[None, :] - both)
        if key[1].as_py() != key[2].as_py():
            linked &= block[:, None] != block[None, :]
        found = np.array(spanning(linked), "i8").reshape(-1, 2)
        return pa.table([pa.array(uid[found[:, 0]]), pa.array(uid[found[:, 1]])], ["a", "b"])

    p = pairs.select(F.col("cluster").alias("c"), "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("at"))
    both = members.join(p, (F.col("cluster") == F.col("c")) & (F.col("block") == F.col("at")))
    return both.select("cluster", "i", "j", "block", "uid", "shingles").groupBy("cluster", "i", "j").applyInArrow(meet, "a long, b long")


def _dealt(members: DataFrame, by: list[str], block: int) -> DataFrame:
    """members with ``part``: each group of ``by`` dealt at random into parts of bounded size."""
    size = members.groupBy(*by).agg(F.ceil(F.greatest(F.count("*") / block, F.sum("weight") / SHINGLES)).cast("long").alias("parts"))
    return members.join(size, by).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")))


def _classes(members: DataFrame, least: float, block: int, few: int) -> DataFrame:
    """(node, root) of the members that are linked to any. members: cluster, uid, weight, shingles."""
    dealt = saved(_dealt(members, ["cluster"], block).withColumnRenamed("part", "block"), "blocks")
    sizes = dealt.groupBy("cluster").agg(F.max("parts").alias("n"))
    every = lambda n: F.explode(F.expr(f"flatten(transform(sequence(0L, {n} - 1), i -> transform(sequence(i, {n} - 1), j -> struct(i, j))))"))
    one = sizes.where(F.col("n") <= few).select("cluster", every("n").alias("p")).select("cluster", "p.i", "p.j")
    star = sizes.where(F.col("n") > few).select("cluster", F.lit(0).cast("long").alias("i"), F.explode(F.expr("sequence(0L, n - 1)")).alias("j"))
    links = saved(_links(dealt, one.union(star), least), "links")
    found = saved(components(links), "classes")
    large = sizes.where(F.col("n") > few).select("cluster")
    if not large.limit(1).count():
        discard(dealt, links)
        return found
    # members of a class that fills a block are dealt among themselves; all others are dealt together
    rest = dealt.join(large, "cluster", "left_semi").drop("block", "part", "parts").join(found.select(F.col("node").alias("uid"), "root"), "uid", "left")
    much = rest.where("root is not null").groupBy("cluster", "root").agg(F.count("*").alias("n")).where(F.col("n") >= block).select(F.col("cluster").alias("mc"), F.col("root").alias("mr"))
    rest = rest.join(much, (F.col("cluster") == F.col("mc")) & (F.col("root") == F.col("mr")), "left").withColumn("pure", F.coalesce("mr", F.lit(-1))).drop("mc", "mr", "root")
    again = saved(_dealt(rest, ["cluster", "pure"], block).withColumn("block", F.xxhash64("pure", "part")), "blocks")
    blocks = again.select("cluster", "pure", "block").distinct()
    other = blocks.select(F.col("cluster").alias("c2"), F.col("pure").alias("p2"), F.col("block").alias("j"))
    pairs = blocks.join(other, (F.col("cluster") == F.col("c2")) & (F.col("block") <= F.col("j"))).where((F.col("pure") < 0) | (F.col("pure") != F.col("p2"))).select("cluster", F.col("block").alias("i"), "j")
    more = saved(_links(again, pairs, least), "links")
    out = saved(components(links.union(more)), "classes")
    discard(dealt, links, found, again, more)
    return out


def _members(docs: DataFrame, least: float, block: int = BLOCK, few: int = FEW) -> tuple[DataFrame, dict[str, str], DataFrame]:
    """docs numbered, its columns' names there, and f, r, doc_id, class_id, class_size, keep of each row."""
    rows, at = numbered(docs)
    doc_id, text = at["doc_id"], at["text"]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    hashed = saved(rows.select(F.monotonically_increasing_id().alias("uid"), "f", "r", F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("h1"), F.xxhash64(F.lit(1), whole).alias("h2")), "hashed")
    # the least uid stands for all copies of a text
    copies = saved(hashed.groupBy("h1", "h2").agg(F.min("uid").alias("rep")), "copies")
    firsts = hashed.join(copies.select(F.col("rep").alias("uid")), "uid", "left_semi").select("uid", "f", "r")
    repeats = hashed.join(copies.select(F.col("rep").alias("uid")), "uid", "left_anti").select("f", "r")
    # few copies are left out of the sketching; many cost more to find there than to sketch
    few_repeats = repeats.limit(BROADCAST + 1).count() <= BROADCAST
    once = rows.join(F.broadcast(repeats), ["f", "r"], "left_anti") if few_repeats else rows
    sketched = saved(_sketches(once, text).join(firsts, ["f", "r"]).select("uid", "f", "r", "weight", "keys"), "sketches")
    bands = sketched.select("uid", F.explode("keys").alias("key"))
    often = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("uid").alias("first")).where("n > 1").select("key", "first")
    near = saved(bands.join(often, "key"), "near")  # key, uid, first
    names = copies
    if near.limit(1).count():
        wanted = sketched.join(near.select("uid").distinct(), "uid", "left_semi").select("uid", "f", "r", "weight")

        def prepare(batches):
            for part in parts(batches, "text"):
                yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("weight"), pa.array(shingle_sets(part.column("text")), pa.binary())], ["uid", "weight", "shingles"])

        texts = rows.select("f", "r", F.col(text).cast("string").alias("text")).join(small(wanted), ["f", "r"]).select("uid", "weight", "text")
        sets = saved(texts.mapInArrow(prepare, "uid long, weight long, shingles binary"), "sets")
        meet = lambda stars: _classes(sets.join(stars, "uid").select(F.col("first").alias("cluster"), "uid", "weight", "shingles"), least, block, few)
        # each document's first star finds most classes; the other stars of a bucket that is one class by then have nothing to add
        found = meet(near.groupBy("uid").agg(F.min("first").alias("first")))
        classed = near.join(found, near["uid"] == found["node"], "left").withColumn("class", F.coalesce("root", "uid"))
        open_keys = classed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("key")
        rest = saved(near.join(open_keys, "key", "left_semi").select("uid", "first").distinct(), "rest")
        if rest.limit(1).count():
            found = saved(components(found.union(meet(rest)), "node", "root"), "classes")
        discard(sets, rest)
        names = copies.join(found, copies["rep"] == found["node"], "left").select("h1", "h2", F.coalesce("root", "rep").alias("rep"))
    of = saved(hashed.join(names, ["h1", "h2"]).select("uid", "f", "r", "doc_id", "rep"), "members")
    discard(hashed, copies, sketched, near)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    group = of.groupBy("rep").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min(order)["uid"].alias("kept"))
    return rows, at, of.join(group, "rep").select("f", "r", "doc_id", "class_id", "class_size", (F.col("uid") == F.col("kept")).alias("keep"))


def near_classes(docs: DataFrame, least: float = 0.8, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """doc_id, class_id (its class's smallest doc_id), class_size, keep of every row."""
    return _members(docs, least, block, few)[2].drop("f", "r")


def one_of_each(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows that their classes keep, with all columns."""
    rows, at, members = _members(docs, least)
    left = rows.join(small(members.where("not keep").select("f", "r")), ["f", "r"], "left_anti")
    return left.select(*[F.col(c).alias(n) for n, c in at.items()])
