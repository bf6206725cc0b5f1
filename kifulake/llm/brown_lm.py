r"""Brown class-based bigram scores.

A text is its words ([^\x20\x09-\x0D]+, A-Z lower-cased) and one end token. The model is
P(w | before) = P(class(w) | class(before)) * P(w | class(w)); a text starts after an end.

Learning, over all training texts:
1. token counts: counted in each task, combined by a shuffle on the token (one row for each
   token and a few million tokens of text), kept as a table;
2. exchange clustering of the ``core`` most frequent tokens on their bigram counts: each in
   turn goes to the class that raises the class-bigram likelihood most. This is where the
   classes start, not what they end as;
3. batch exchange rounds over all tokens seen ``least`` times or more, the core's included:
   the classes of a token's neighbours are counted, and it goes to the class that these make
   likeliest. In the first round the core's classes alone are known; ``rounds`` follow with
   all of them. Of these the classes with the highest class-bigram likelihood are kept;
4. class transitions and sizes, counted over all texts.
Tokens seen less often are a class of their own, and so is any that no training text holds:
what is known of the one kind is the best guess at the other. Both factors are smoothed:
transitions towards the class unigram, emissions by adding one to each token of a class and
to one unknown token.

Tokens are told apart by 64-bit numbers (``words.hashes``). ``hot`` bounds what is broadcast
(17 bytes a token) and nothing else: the classes of that many tokens seen twice or more are looked up
in sorted arrays, the others' come from joins on the token. A token outside the hot ones holds
less than 1 in ``hot`` of all tokens (held-out texts count there), so no join has a hot key.
Counts of the most frequent tokens are summed up over a whole task before they are shuffled.

Null text counts as empty (an end token alone), a null doc_id is in no held-out fold;
repeated rows are scored each; an empty table gives an empty result; a very long text is one
row like any other; other columns are ignored. Ties between classes go to the lower one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, in_small_batches, offsets, parts, saved
from .words import hashes

#: The numbers of the end token and of all tokens seen too rarely to be told apart.
END, RARE = -0x5DEECE66D0000001, -0x5DEECE66D0000002
#: The fold that is held out.
FOLDS, HELD_OUT = 7, 2
#: Tokens of text that are counted together (one that is new to its megabyte counts for three), and tokens whose neighbours are counted over a whole task.
GROUP, DENSE = 8_000_000, 4_096
#: Sorted keys that are turned into rows together.
SLICE = 1 << 18
#: Of a neighbour's class and its count in one number: the bits of the count.
BITS = 24


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' numbers of all texts in a row, and how many each text has."""
    words, n = hashes(texts, fold=True)
    out = np.empty(len(words) + len(n), "i8")
    is_end = np.zeros(len(out), bool)
    is_end[np.cumsum(n + 1) - 1] = True
    out[is_end], out[~is_end] = END, words.view("i8")
    return out, n + 1


def coded(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, and of each number its place among them, in 32 bits: see ``joint``."""
    found = pa.array(numbers).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def joint(a: np.ndarray, n: int, b: np.ndarray, cells: int) -> np.ndarray:
    """a * n + b, less than cells, in 32 bits where that holds it: a worker's memory is mostly these."""
    kind = "i4" if cells <= 1 << 31 else "i8"
    out = a.astype(kind)
    out *= n
    out += b.astype(kind, copy=False)
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """Of some millions of tokens at a time the distinct ones, END among them, and parts of
    the text: the tokens' places among these in a row, and how many each text has. Beside
    the distinct ones, no more than four bytes a token are held."""
    held, n = [], 0
    for part in parts(batches, "text"):
        numbers, sizes = tokens(part.column("text"))
        held.append((*coded(numbers), sizes))
        n += len(numbers) + 2 * len(held[-1][0])
        if n >= GROUP:
            yield _joined(held)
            n = 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The parts (distinct tokens, places among them, sizes) as one, the tokens ascending; held
    is empty then, and each part goes when it is read. Sorting takes less memory than a hash table."""
    every, cuts = np.concatenate([x[0] for x in held]), np.cumsum([0, *(len(x[0]) for x in held)])
    left = [(start, stop, *x[1:]) for start, stop, x in zip(cuts[:-1], cuts[1:], held, strict=True)][::-1]
    held.clear()
    order = np.argsort(every)
    every = every[order]
    new = np.r_[True, every[1:] != every[:-1]]
    at = np.empty(len(every), "i4")
    at[order] = np.cumsum(new, dtype="i4") - 1
    names = every[new]
    del every, order

    def each():
        while left:
            start, stop, places, sizes = left.pop()
            yield at[start:stop][places], sizes

    return names, each()


def _runs(keys: list[np.ndarray], width: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct ones among keys, ascending, and how often each comes: some at a time, but
    those with one keys // width together. The list is empty then."""
    every = np.concatenate(keys) if keys else np.zeros(0, "i8")
    keys.clear()
    every.sort()
    start = 0
    while start < len(every):
        stop = min(start + SLICE, len(every))
        if stop < len(every):
            low = int(every[stop]) // width * width
            stop = int(every.searchsorted(every.dtype.type(low)))
            if stop <= start:
                stop = int(every.searchsorted(every.dtype.type(low + width - 1), "right"))
        own = every[start:stop]
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        yield own[cuts].astype("i8"), np.diff(np.r_[cuts, len(own)])
        start = stop


def previous(ids: np.ndarray, sizes: np.ndarray, first: int) -> np.ndarray:
    """What stands before each token of its text; first: before a text's first."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    if len(sizes):
        out[np.cumsum(sizes) - sizes] = first
    return out


def xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = 8) -> np.ndarray:
    """A class for each word (in descending frequency) from its word-bigram counts.

    Starts with the most frequent words in classes of their own; ties keep the lower class.
    """
    n = len(bigrams)
    of = np.minimum(np.arange(n), classes - 1)
    member = np.eye(classes)[of]
    right, left = bigrams @ member, bigrams.T @ member  # word by class that follows / precedes
    pair = member.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            old, own = of[w], bigrams[w, w]
            r, s = right[w].copy(), left[w].copy()
            r[old] -= own
            s[old] -= own  # its neighbours, without itself
            pair[old] -= r
            pair[:, old] -= s
            pair[old, old] -= own
            row, col = pair.sum(axis=1) + s, pair.sum(axis=0) + r  # these parts come whichever class w joins
            diag = np.diag(pair)
            gain = (xlogx(pair + r) - xlogx(pair)).sum(axis=1) + (xlogx(pair + s[:, None]) - xlogx(pair)).sum(axis=0)
            gain += xlogx(diag + r + s + own) - xlogx(diag + r) - xlogx(diag + s) + xlogx(diag)
            gain -= xlogx(row + r.sum() + own) - xlogx(row) + xlogx(col + s.sum() + own) - xlogx(col)
            new = int(np.argmax(gain))
            pair[new] += r
            pair[:, new] += s
            pair[new, new] += own
            if new != old and gain[new] > gain[old] + 1e-9:
                moved += 1
                of[w] = new
                right[:, old] -= bigrams[:, w]
                right[:, new] += bigrams[:, w]
                left[:, old] -= bigrams[w]
                left[:, new] += bigrams[w]
            elif new != old:
                pair[new] -= r
                pair[:, new] -= s
                pair[new, new] -= own
                pair[old] += r
                pair[:, old] += s
                pair[old, old] += own
        if not moved:
            break
    return of


@dataclass
class Model:
    """What a worker needs: bounded by ``hot`` and the number of classes. The class k - 1 is that of rare tokens."""

    words: np.ndarray  # frequent tokens' numbers, ascending
    counts: np.ndarray
    of: np.ndarray  # their classes; -1: none yet
    k: int
    complete: bool  # whether all tokens that have a class of their own are among these
    total: int = 0
    distinct: int = 0
    moves: np.ndarray | None = None  # log10 P(class | class before)
    sizes: np.ndarray | None = None  # tokens of each class
    kinds: np.ndarray | None = None  # distinct tokens of each class

    def places(self, names: np.ndarray) -> np.ndarray:
        """Of each token its place among the frequent ones; -1: it isn't one."""
        at = np.minimum(np.searchsorted(self.words, names), len(self.words) - 1)
        return np.where(self.words[at] == names, at, -1)

    def end(self) -> int:
        return int(self.of[self.places(np.array([END]))[0]])


def token_counts(docs: DataFrame) -> DataFrame:
    """docs: text, training. word, c (in training texts), seen (in all)."""

    def count(batches):
        held, size = [], 0

        def summed():
            columns = [list(x) for x in zip(*held, strict=True)]
            held.clear()
            words = np.concatenate(columns[0])
            columns[0].clear()
            order = np.argsort(words)
            words = words[order]
            starts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
            out = [words[starts]]
            del words
            for x in columns[1:]:  # one by one: these are millions
                every = np.concatenate(x, dtype="i8")
                x.clear()
                out.append(np.add.reduceat(every[order], starts))
            return tuple(out)

        def rows():
            for i in range(0, len(held[0][0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in held[0]], ["word", "c", "seen"])

        for part in parts(batches, "text"):
            numbers, sizes = tokens(part.column("text"))
            names, at = coded(numbers)
            training = np.repeat(part.column("training").to_numpy(zero_copy_only=False).astype(bool), sizes)
            held.append((names, *(np.bincount(x, minlength=len(names)).astype("i4") for x in (at[training], at))))
            size += len(names)
            if size > 1 << 21:
                held[:] = [summed()]
                size = len(held[0][0])
                if size > 1 << 20:
                    yield from rows()
                    held, size = [], 0
        if held:
            held[:] = [summed()]
            yield from rows()

    return docs.mapInArrow(count, "word long, c long, seen long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def _least_frequent(counts: DataFrame, hot: int) -> int:
    """The least count that at most ``hot`` tokens reach. A top-k would send each task's own
    top to the driver; this sums up by count, of which there are at most sqrt(2 N)."""
    each = counts.groupBy("seen").agg(F.count("*").alias("n"))
    reached = each.selectExpr("seen", "sum(n) over (order by seen desc rows unbounded preceding) as reached")
    found = reached.where(F.col("reached") <= hot).agg(F.min("seen")).first()[0]
    return found if found is not None else 1 << 62


def _core_bigrams(training: DataFrame, core: np.ndarray) -> np.ndarray:
    """How often each of the core tokens stands before each."""
    order = np.argsort(core)
    shared = training.sparkSession.sparkContext.broadcast((core[order], order))
    n = len(core)

    def count(batches):
        names_of, place = shared.value
        out = np.zeros(n * n, "i8")
        for names, texts in _groups(batches):
            found = np.minimum(np.searchsorted(names_of, names), n - 1)
            mine = np.where(names_of[found] == names, place[found], -1).astype("i4")
            first, keys = int(mine[names == END][0]), []
            for at, sizes in texts:
                here = mine[at]
                before = previous(here, sizes, first)
                both = (here >= 0) & (before >= 0)
                keys.append(joint(before[both], n, here[both], n * n))
            out += np.bincount(np.concatenate(keys), minlength=n * n)
        some = np.flatnonzero(out)
        for i in range(0, len(some), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 100_000]), pa.array(out[some[i : i + 100_000]])], ["cell", "n"])

    found = training.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # core * core rows at most
    out = np.zeros(n * n)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(n, n)


def _entries(side: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the input, number) of as many numbers as hold each side with its count."""
    most = (1 << BITS) - 1
    times = np.maximum(1, -(-n // most))
    at = np.repeat(np.arange(len(n)), times)
    first = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
    count = np.where(first, n[at] - (times[at] - 1) * most, most)
    return at, (side[at] << BITS | count).astype(">u4")


def neighbours(training: DataFrame, model: Model) -> DataFrame:
    """word, blob: the classes of a token's neighbours (before it, or after it and then with k
    added) with their counts. Where the neighbour isn't a frequent token, beside is that
    token, blob is null, side 0 or k, and n the count. Neighbours without a class don't count."""
    shared = training.sparkSession.sparkContext.broadcast(model)

    def count(batches):
        m = shared.value
        k, dense = m.k, min(DENSE, len(m.words))
        slots = np.full(len(m.words), -1, "i4")
        top = np.argpartition(m.counts, len(m.counts) - dense)[-dense:].copy()  # not a view: that holds them all
        slots[top] = np.arange(dense)
        whole = np.zeros(dense * 2 * k, "i8")

        def rows(word, side, n):
            """Of sorted words."""
            at, entries = _entries(side, n)
            cuts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, "i8")
            ends = np.searchsorted(at, np.r_[cuts, len(word)])
            names, raw = word[cuts], entries.tobytes()
            for i in range(0, len(names), 50_000):
                some = ends[i : i + 50_001]
                blob = pa.Array.from_buffers(pa.binary(), len(some) - 1, [None, pa.py_buffer((4 * (some - some[0])).astype("i4").tobytes()), pa.py_buffer(raw[4 * some[0] : 4 * some[-1]])])
                none = pa.nulls(len(blob), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 50_000]), blob, none, pa.nulls(len(blob), pa.int32()), none], ["word", "blob", "beside", "side", "n"])

        def asked(names, keys, n, shift):
            again, number = _entries(np.zeros(len(n), "i8"), n)
            left = names[keys[again] // len(names)], names[keys[again] % len(names)], number.astype("i8")
            for i in range(0, len(again), 100_000):
                word, beside, n = (pa.array(x[i : i + 100_000]) for x in left)
                yield pa.RecordBatch.from_arrays([word, pa.nulls(len(n), pa.binary()), beside, pa.array(np.full(len(n), shift, "i4")), n], ["word", "blob", "beside", "side", "n"])

        for names, texts in _groups(batches):
            place = m.places(names)
            of = np.where(place >= 0, m.of[place], k - 1 if m.complete else -2).astype("i4")
            first = int(np.flatnonzero(names == END)[0])
            if m.complete:  # tokens that aren't frequent are all rare ones
                alias = np.where(place >= 0, np.arange(len(names)), len(names)).astype("i4")
                titles = np.r_[names, RARE]
            else:
                alias, titles = np.arange(len(names), dtype="i4"), names
            slot = np.where(place >= 0, slots[place], -1).astype("i4")
            del place
            keys, unknown = [], {0: [], k: []}
            for at, sizes in texts:
                before, often = previous(at, sizes, first), []
                for word, beside, shift in ((at, before, 0), (before, at, k)):
                    cls, mine = of[beside], slot[word]
                    some = (cls >= 0) & (mine >= 0)
                    often.append(joint(mine[some], 2 * k, cls[some] + shift, len(whole)))
                    rest = (cls >= 0) & (mine < 0)
                    keys.append(joint(alias[word[rest]], 2 * k, cls[rest] + shift, len(titles) * 2 * k))
                    if not m.complete:
                        gone = cls == -2
                        unknown[shift].append(joint(word[gone], len(names), beside[gone], len(names) ** 2))
                whole += np.bincount(np.concatenate(often), minlength=len(whole))
            for shift, open_ in unknown.items():
                for found, n in _runs(open_):
                    yield from asked(names, found, n, shift)
            for found, n in _runs(keys, 2 * k):
                yield from rows(titles[found // (2 * k)], found % (2 * k), n)
        some = np.flatnonzero(whole)
        yield from rows(m.words[top][some // (2 * k)], some % (2 * k), whole[some])

    return training.mapInArrow(count, "word long, blob binary, beside long, side int, n long")


def class_bigrams(training: DataFrame, now: DataFrame, model: Model) -> np.ndarray:
    """How often each class stands before each."""
    shared, k = training.sparkSession.sparkContext.broadcast(model), model.k

    def count(batches):
        m, whole = shared.value, np.zeros(k * k, "i8")
        for names, texts in _groups(batches):
            place = m.places(names)
            of = np.where(place >= 0, m.of[place], k - 1 if m.complete else -1).astype("i4")
            first, unknown = int(np.flatnonzero(names == END)[0]), []
            for at, sizes in texts:
                before = previous(at, sizes, first)
                x, y = of[before], of[at]
                known = (x >= 0) & (y >= 0)
                whole += np.bincount(joint(x[known], k, y[known], k * k), minlength=k * k)
                if not m.complete:
                    unknown.append(joint(before[~known], len(names), at[~known], len(names) ** 2))
            for keys, n in _runs(unknown):
                yield from _open_pairs(names, of, keys // len(names), keys % len(names), n)
        cells = np.flatnonzero(whole)
        none = pa.nulls(len(cells), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array((cells // k).astype("i4")), none, pa.array((cells % k).astype("i4")), pa.array(whole[cells])], ["a", "a_of", "b", "b_of", "n"])

    rows = training.mapInArrow(count, "a long, a_of int, b long, b_of int, n long")
    if not model.complete:
        rows = _classed(rows, now)
    out = np.zeros((k, k))
    for r in rows.groupBy("a_of", "b_of").agg(F.sum("n").alias("n")).collect():  # classes * classes rows at most
        out[r["a_of"], r["b_of"]] = r["n"]
    return out


def _open_pairs(names: np.ndarray, of: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows a, a_of, b, b_of, n of neighbours: a token's number where its class isn't known, else its class."""
    for i in range(0, len(a), 100_000):
        x, y = a[i : i + 100_000], b[i : i + 100_000]
        columns = [pa.array(z, mask=gone) for w in (x, y) for z, gone in ((names[w], of[w] >= 0), (of[w].astype("i4"), of[w] < 0))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n[i : i + 100_000])], ["a", "a_of", "b", "b_of", "n"])


def _classed(rows: DataFrame, now: DataFrame) -> DataFrame:
    """rows (a, a_of, b, b_of, ...) with a_of and b_of looked up where they are null; a null token matches nothing."""
    for x in ("a", "b"):
        of = now.select(F.col("word").alias(x), F.col("of").alias("found"))
        rows = rows.join(of, x, "left").withColumn(f"{x}_of", F.coalesce(f"{x}_of", "found")).drop("found")
    return rows


def _round(training: DataFrame, now: DataFrame, model: Model, pair: np.ndarray, size: np.ndarray, least: int) -> DataFrame:
    """The table (word, c, of) with each token seen often enough in the class that its
    neighbours' classes make likeliest, given how often classes follow each other. A token
    without neighbours that have a class goes to the largest class."""
    k = model.k
    counted, none = neighbours(training, model), F.lit(None)
    if not model.complete:
        counted = saved(counted, "neighbours")  # read twice
    rows = counted.where("blob is not null").select("word", "blob")
    if not model.complete:
        of = now.select(F.col("word").alias("beside"), "of").where("of >= 0")
        asked = counted.where("blob is null").drop("blob").join(of, "beside")
        number = F.shiftleft((F.col("of") + F.col("side")).cast("long"), BITS) + F.col("n")
        rows = rows.union(asked.select("word", F.unhex(F.lpad(F.hex(number), 8, "0"))))
    rows = rows.withColumn("c", none.cast("long")).union(now.select("word", none.cast("binary"), "c"))
    grouped = rows.repartition("word").sortWithinPartitions("word")
    soft = pair + 0.1
    follows, large, most = np.log(soft / soft.sum(axis=1, keepdims=True)), np.log(size + 1.0), int(size[: k - 1].argmax())

    def place(batches):
        for word, c, n in _words(batches, k):
            gain = (n[:, :k] @ follows + n[:, k:] @ follows.T - (n.sum(axis=1) / 2)[:, None] * large)[:, : k - 1]
            top = gain.max(axis=1, keepdims=True)
            new = (gain >= top - 1e-9 * (1 + np.abs(top))).argmax(axis=1)  # ties keep the lower class, however sums are rounded
            new = np.where(n.any(axis=1), new, most)
            new = np.where((c >= least) | (word == END), new, k - 1)
            own = word != RARE
            yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (word, c, new.astype("i4"))], ["word", "c", "of"])

    after = saved(grouped.mapInArrow(place, "word long, c long, of int"), "classes")
    if not model.complete:
        discard(counted)
    return after


def _words(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(word, c, counts of its neighbours' classes) of rows sorted by word, one of which has c;
    a word's rows may go on in later batches."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        word = batch.column("word").to_numpy()
        new = np.r_[True, word[1:] != word[:-1]]
        starts, number = np.flatnonzero(new), np.cumsum(new) - 1
        blobs = batch.column("blob").fill_null(b"") if batch.column("blob").null_count else batch.column("blob")
        cuts = offsets(blobs).astype("i8")
        entries = np.frombuffer(blobs.buffers()[2] or b"", ">u4", (cuts[-1] - cuts[0]) // 4, cuts[0]).astype("i8") if cuts[-1] > cuts[0] else np.zeros(0, "i8")
        owner = np.repeat(number, np.diff(cuts) // 4)
        n = np.bincount(owner * 2 * k + (entries >> BITS), weights=entries & ((1 << BITS) - 1), minlength=len(starts) * 2 * k).reshape(-1, 2 * k)
        now = [word[starts], np.maximum.reduceat(batch.column("c").fill_null(0).to_numpy(), starts), n]
        if held is not None:
            if held[0][0] == now[0][0]:
                now[1][0] = max(now[1][0], held[1][0])
                now[2][0] += held[2][0]
            else:
                yield tuple(held)
        held = [x[-1:] for x in now]
        yield tuple(x[:-1] for x in now)
    if held is not None:
        yield tuple(held)


@in_small_batches
def learn(docs: DataFrame, training: Column | None = None, hot: int = 2_000_000, core: int = 1_000, classes: int = 64, sweeps: int = 8, rounds: int = 2, least: int = 2) -> tuple[Model | None, DataFrame]:
    """The model and the table of all training tokens (word, c, of). training: which rows it
    learns from (all); the others only count for what is broadcast. None: no training text."""
    spark = docs.sparkSession
    training = F.lit(True) if training is None else training
    rows = docs.select(docs["text"].cast("string").alias("text"), training.alias("training"))
    counts = saved(token_counts(rows), "counts")
    total, distinct = counts.where("c > 0").agg(F.sum("c"), F.count("*")).first()
    if not total:
        return None, counts.withColumn("of", F.lit(0))
    rows = rows.where("training").select("text")
    cut = max(2, _least_frequent(counts, hot))  # what all texts hold once is looked up by a join at any size
    is_hot = (F.col("seen") >= cut) | (F.col("word") == END)
    top = counts.where(is_hot).toArrow().sort_by("word")  # hot + 1 rows at most
    words, c = top["word"].to_numpy(), top["c"].to_numpy()
    complete = counts.where(~is_hot & (F.col("c") >= least)).limit(1).count() == 0
    order = np.lexsort((words, -c))[:core]
    order = order[c[order] > 0]
    inner = _core_bigrams(rows, words[order])
    start = exchange(inner, min(classes, len(order)), sweeps)
    k = int(start.max()) + 2
    of = np.where((c < least) & (words != END), k - 1, -1).astype("i4")
    of[order] = start
    model = Model(words, c, of, k, complete, total, distinct)
    member = np.eye(k)[start]
    pair, size = member.T @ inner @ member, np.bincount(start, weights=c[order], minlength=k)
    table = counts.where("c > 0").withColumn("of", F.when((F.col("c") < least) & (F.col("word") != END), k - 1).otherwise(-1))
    known = spark.createDataFrame(pa.table({"word": words[order], "start": start.astype("i4")}))
    table = table.join(F.broadcast(known), "word", "left").select("word", "c", F.coalesce("start", "of").alias("of"))
    best = None
    for _ in range(rounds + 1):
        after = _round(rows, table, model, pair, size, least)
        of = np.full(len(words), k - 1, "i4")
        hot_now = after if complete else after.join(counts.where(is_hot).select("word"), "word", "left_semi")
        placed = hot_now.where((F.col("c") >= least) | (F.col("word") == END)).select("word", "of").toArrow()  # hot + 1 rows at most
        of[np.searchsorted(words, placed["word"].to_numpy())] = placed["of"].to_numpy()
        model = Model(words, c, of, k, complete, total, distinct)
        pair = class_bigrams(rows, after, model)
        model.kinds, model.sizes = _sizes(after, k)
        likely = float(xlogx(pair).sum() - xlogx(pair.sum(axis=0)).sum() - xlogx(pair.sum(axis=1)).sum() + 0.0)
        table, size = after, model.sizes
        if best is not None and likely <= best[0]:
            discard(after)
            break
        if best is not None:
            discard(best[2])
        share = (model.sizes + 1) / (model.sizes.sum() + k)
        model.moves = np.log10((pair + 2.0 * share) / (pair.sum(axis=1, keepdims=True) + 2.0))
        best = likely, model, after
    return best[1], best[2]


def _sizes(now: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens and tokens of each class."""
    kinds, n = np.zeros(k), np.zeros(k)
    for r in now.groupBy("of").agg(F.count("*").alias("kinds"), F.sum("c").alias("n")).collect():
        kinds[r["of"]], n[r["of"]] = r["kinds"], r["n"]
    return kinds, n


@in_small_batches
def score(docs: DataFrame, model: Model | None, table: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row.

    A pass over the texts scores what the broadcast tokens tell. What it can't know (counts
    of the other tokens; transitions from or to them, where they may have classes) follows by
    joins on the token, and is summed up by row.
    """
    if model is None:
        one = np.ones(1)
        model = Model(np.array([END]), np.zeros(1, "i8"), np.zeros(1, "i4"), 1, True, 0, 0, np.zeros((1, 1)), 0 * one, 0 * one)
    shared, k = docs.sparkSession.sparkContext.broadcast(model), model.k
    all_tokens = model.total + 1.0 * (model.distinct + 1)
    room = model.sizes + model.kinds + 1
    names_out = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rest", "open"]
    rest_kind = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))
    pair_names = ["a", "a_of", "b", "b_of", "n"]
    open_kind = pa.list_(pa.struct(list(zip(pair_names, (pa.int64(), pa.int32()) * 2 + (pa.int64(),), strict=True))))

    def local(batches):
        m, uid = shared.value, TaskContext.get().partitionId() << 40
        for part in parts(batches, "text"):
            numbers, sizes = tokens(part.column("text"))
            names, at = coded(numbers)
            place = m.places(names)
            of = np.where(place >= 0, m.of[place], k - 1 if m.complete else -1)
            hot = place >= 0
            c = m.counts[place]
            known, base, emit = hot & (c > 0), np.where(hot, np.log10((c + 1) / all_tokens), 0), np.where(hot, np.log10((c + 1) / room[m.of[place]]), 0)
            before = previous(at, sizes, int(np.flatnonzero(names == END)[0]))
            both = (of[before] >= 0) & (of[at] >= 0)
            starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
            moved = np.where(both, m.moves[of[before], of[at]], 0.0)
            gone = ~hot[at]
            keys, n = np.unique(joint(owner[gone], len(names), at[gone], len(sizes) * len(names)), return_counts=True)
            rest = pa.StructArray.from_arrays([pa.array(names[keys % len(names)]), pa.array(n)], ["word", "n"])
            rest_ends = np.searchsorted(keys // len(names), np.arange(len(sizes) + 1))
            mine = np.flatnonzero(~both)
            pairs = pa.concat_tables([pa.Table.from_batches([x]) for x in _open_pairs(names, of, before[mine], at[mine], np.ones(len(mine), "i8"))]).combine_chunks() if len(mine) else None
            pairs = pa.StructArray.from_arrays([pairs[x].combine_chunks() for x in pair_names], pair_names) if len(mine) else pa.array([], open_kind.value_type)
            open_ends = np.searchsorted(owner[mine], np.arange(len(sizes) + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(uid + np.arange(len(sizes))), part.column("doc_id"), part.column("held_out"), pa.array(sizes),
                    pa.array(np.add.reduceat(known[at].astype("i8"), starts)),
                    pa.array(np.add.reduceat(base[at], starts)),
                    pa.array(np.add.reduceat(emit[at] + moved, starts)),
                    pa.ListArray.from_arrays(pa.array(rest_ends, pa.int32()), rest).cast(rest_kind),
                    pa.ListArray.from_arrays(pa.array(open_ends, pa.int32()), pairs).cast(open_kind),
                ],
                names_out,
            )
            uid += len(sizes)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), docs["text"].cast("string").alias("text"))
    shape = f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rest array<struct<word:long,n:long>>, open array<struct<a:long,a_of:int,b:long,b_of:int,n:long>>"
    rows = saved(rows.mapInArrow(local, shape), "scored")
    rest = rows.select("uid", F.inline("rest")).join(table.select("word", "c", "of"), "word", "left")
    c, of = F.coalesce("c", F.lit(0)), F.coalesce("of", F.lit(k - 1))
    emitted = F.log10((c + 1) / F.get(F.array(*[F.lit(float(x)) for x in room]), of))
    more = rest.select("uid", (F.col("n") * (c > 0).cast("long")).alias("known"), (F.col("n") * F.log10((c + 1) / all_tokens)).alias("base"), (F.col("n") * emitted).alias("score"))
    if not model.complete:
        found = _classed(rows.select("uid", F.inline("open")), table.select("word", "of"))
        a, b = (F.coalesce(x, F.lit(k - 1)) for x in ("a_of", "b_of"))
        moves = docs.sparkSession.createDataFrame([([float(x) for x in model.moves.ravel()],)], "moves array<double>")
        found = found.crossJoin(F.broadcast(moves))  # one row
        more = more.union(found.select("uid", F.lit(0).cast("long"), F.lit(0.0), F.col("n") * F.get("moves", a * k + b)))
    more = more.groupBy("uid").agg(F.sum("known").alias("known"), F.sum("base").alias("more_base"), F.sum("score").alias("more_score"))
    both = rows.drop("rest", "open").join(more, "uid", "left")
    base, total = (F.col(x) + F.coalesce(f"more_{x}", F.lit(0.0)) for x in ("base", "score"))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(model.total)).cast("long").alias("train_tokens"), base.alias("base_score"), total.alias("score"), F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"))
