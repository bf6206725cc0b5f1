"""Phrase collocations against brute force, chunks, sketches."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from kifulake.llm import collocations as col

NAMES = "doc_id long, text string, lang string, phrase int, a int, n int, level int, block int"
MARKS = [" ", " ", " ", " ", "\t", "  ", ", ", ".", "\n", " ! ", "\r\n", "\x0b", "\x1c", "\xa0"]


def brute(rows, least, longest, first):
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(upper)):
            w = re.findall(r"[^\x20\x09]+", piece)
            lang = "und" if lang is None else lang
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    own = {x: a for x, a in f.items() if a >= least and len(x[1]) >= 2}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = collections.defaultdict(list)
    for (lang, p), a in own.items():
        if any(m == lang and len(q) > len(p) and b >= a and inside(p, q) for (m, q), b in own.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:first], 1)}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["the", "The", "of", "new", "york", "times", "é", "李", "a", "aa", "a-b", "\x00", "x"] + [f"w{i}" for i in range(20)]
    text = lambda n: "".join(rng.choice(words[: rng.choice([4, 8, 33])]) + rng.choice(MARKS) for _ in range(n))
    out = [(i, text(rng.randrange(60)), rng.choice(["en", "en", "de", None, "", "und"])) for i in range(120)]
    return out + [(None, "new york times " * 40, "en"), (1, None, "en"), (2, "", None), (3, "a " * 90, "fr"), (3, "a " * 90, "fr"), (4, "new york times of the w1 w2 " * 3000, "en")]


@pytest.mark.parametrize(("chunk", "width"), [(1 << 20, 1 << 20), (64, 1 << 20), (300, 8)])
def test_against_brute_force(spark, rows, chunk, width):
    # also with chunks of a few words, and with a sketch so narrow that all its buckets are full
    sizes = col.Sizes(fewest=width, most=width, block=min(width, 1 << 18), chunk=chunk, kept=500, phrases=50)
    docs = spark.createDataFrame([(*r, 0, 0, 0, 0, 0) for r in rows], NAMES).repartition(3)
    got = {tuple(r) for r in col.collocations(docs, least=6, first=50, sizes=sizes).collect()}
    want = brute(rows, 6, 5, 50)
    assert {w[0] for w in want} >= {"en", "und", "fr"} and got == want


def test_ranks_and_exact_products(spark):
    big = 3 * 10**12
    counts = [("en", "", 4 * big), ("en", "a", big), ("en", "b", big + 1), ("en", "a b", big - 7), ("en", "b a", big - 7), ("xx", "", 5)]
    rows = col.ranked(spark.createDataFrame(counts, "lang string, phrase string, a long"), spread=3).collect()
    score = 1000 * (big - 7) * 4 * big // (big * (big + 1))
    assert [tuple(r) for r in rows] == [("en", 1, "a b", big - 7, big, big + 1, 4 * big, score), ("en", 2, "b a", big - 7, big + 1, big, 4 * big, score)]


def test_empty(spark):
    assert col.collocations(spark.createDataFrame([], NAMES)).collect() == []
    assert col.collocations(spark.createDataFrame([(1, "a b", "en", 0, 0, 0, 0, 0)], NAMES)).collect() == []


def test_chunks_hold_each_phrase_once():
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice(["a", "bb", "é", "x" * 60, "."]) + rng.choice([" ", " ", "\n"]) for _ in range(rng.randrange(80)))
        batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]})
        got, n = collections.Counter(), 0
        for lang, chunk, again in col.chunks(iter([batch]), 3, 20):
            c = col.Chunk(lang, chunk, again, 3)
            n += len(c)
            for k in (1, 2, 3):
                got.update(c.text[c.starts[i] : c.ends[i + k - 1]].decode() for i in np.flatnonzero(c.within[k - 1]))
        pieces = [p.split() for p in re.split(r"[.\n]", text)]
        assert n == sum(map(len, pieces)) and got == collections.Counter(" ".join(w[i : i + k]) for w in pieces for k in (1, 2, 3) for i in range(len(w) - k + 1))


def test_sketch_never_counts_too_little():
    rng = np.random.default_rng(3)
    found = rng.integers(0, 1 << 20, 50_000).astype("u4")
    found[:30_000] %= 5000
    total = np.zeros(1 << 20, "u4")
    for block, size, data in col.packed(found, 7, 1 << 18):
        total[block << 18 :][: 1 << 18] = col.counters(size, data, 1 << 18)
    assert (total == np.minimum(np.bincount(found, minlength=1 << 20), 7)).all()
