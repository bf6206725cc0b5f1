"""The corpus operators' pieces, against brute force and without Spark."""

import collections
import math
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kifulake.llm import bagminhash, brown_lm, decontaminate, line_dedup, packing, quality_rules, record_files, text_stats, token_counts, words
from kifulake.llm.encode import PieceEncoder, family

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
HARD = ["", " ", "\n", "a  b\n\n c\t d ", "x\x1cy", "x\x00y", "<|endoftext|> a<|endoftext|>b", "don't isn't 's", "é ñ.", "²³ 12,5 a_b _.", "a b c", "foo...  bar?! ,, .", "ΟΔΟΣ ΑΣ. b", "中文字。 日本 语,", "🙂👍 ok", "a" * 5000]


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("most", [20, 600_000])
def test_pieces_encode_as_the_library_does(path, most):
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("ab é.,'\n \t_1²|́ß-A\x1c中") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    library = Tokenizer.from_file(path)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    encoder, counter = PieceEncoder(path, most), PieceEncoder(path, most, known={"a": 1})
    for i in range(0, len(texts), 97):
        assert [x.tolist() for x in encoder.ids(texts[i : i + 97])] == want[i : i + 97]
        assert counter.lengths(texts[i : i + 97]).tolist() == [len(x) for x in want[i : i + 97]]
    assert family(path) == ("byte" if path == BYTE else "word")


def repeated(words):
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    return len({k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab #|\n\t é", max_size=60), max_size=6))
def test_statistics(texts):
    for text, row in zip(texts, text_stats.statistics(texts), strict=True):
        words = text.encode().split()
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert row[:5].tolist() == [len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated(words)]


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((2000, len(quality_rules.FEATURES)))
    at = quality_rules.FEATURES.index("symbols_per_word")
    y = ((x[:, at] < 0.4) ^ (rng.random(2000) < 0.05)).astype("f8")
    trees = quality_rules.fit(x, y, trees=20)
    assert ((trees.score(x) > 0.5) == (x[:, at] < 0.4)).mean() > 0.95
    probe = np.repeat(x[:50], 21, axis=0)
    probe[:, at] = np.tile(np.linspace(0, 1, 21), 50)
    assert (np.diff(trees.score(probe).reshape(50, 21), axis=1) <= 1e-12).all()


def test_node_arrays_score_as_a_walk_does():
    rng = np.random.default_rng(1)
    x = rng.random((500, len(quality_rules.FEATURES)))
    trees = quality_rules.fit(x, (x[:, 0] + x[:, 3] > 1).astype("f8"), trees=12)

    def walk(row):
        total = trees.start
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.cut[at] else trees.right[at]
            total += trees.value[at]
        return 1 / (1 + math.exp(-total))

    assert trees.score(x).tolist() == pytest.approx([walk(r) for r in x])


@pytest.mark.parametrize("window", [16, 1 << 20])
def test_word_numbers(window, monkeypatch):
    monkeypatch.setattr(words, "WINDOW", window)
    rng = random.Random(2)
    for _ in range(60):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice("ab \n\x1cA\u00e9c") for _ in range(rng.randrange(60))) for _ in range(8)]
        found, sizes = words.hashes(pa.array(["zz", *texts], pa.string()).slice(1), fold=True)
        split = [(t or "").encode().lower().split() for t in texts]
        assert sizes.tolist() == [len(w) for w in split]
        named = dict(zip([w for ws in split for w in ws], found.tolist(), strict=True))
        assert [named[w] for ws in split for w in ws] == found.tolist() and len(set(named.values())) == len(named)


def bag(text):
    w = text.split()
    return collections.Counter(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def jaccard(a, b):
    a, b = bag(a), bag(b)
    return sum((a & b).values()) / sum((a | b).values())


def test_signatures_are_unbiased():
    rng = random.Random(3)
    base = [str(rng.randrange(500)) for _ in range(300)]
    agree, true = [], []
    for _ in range(120):
        a = list(base)
        rng.shuffle(a)
        a += a[:60] * 2
        b = [x if rng.random() > 0.03 else "zz" for x in a]
        s, _ = bagminhash.signatures([" ".join(a), " ".join(b)])
        agree.append((s[0] == s[1]).mean())
        true.append(jaccard(" ".join(a), " ".join(b)))
        assert bagminhash.similarity(" ".join(a), " ".join(b)) == pytest.approx(true[-1])
    assert np.mean(agree) == pytest.approx(np.mean(true), abs=0.02)


def test_overlaps_are_multiset_overlaps():
    rng = random.Random(4)
    texts = [" ".join(str(rng.randrange(3)) for _ in range(rng.randrange(40))) for _ in range(20)]
    got = bagminhash.overlaps([np.frombuffer(x, "u8") for x in bagminhash.shingle_sets(texts)], columns=7)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            if i != j:
                assert got[i, j] == sum((bag(a) & bag(b)).values())


def distance_within(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc ", min_size=1, max_size=20), st.text(alphabet="abc ", max_size=40))
def test_myers(pattern, text):
    assert decontaminate.myers(pattern, text, 99) == distance_within(pattern, text)


def test_finder_finds_all_within_the_budget():
    rng = random.Random(5)
    items = [(i, "".join(rng.choice("abcdef ") for _ in range(rng.randrange(1, 90))).strip() or "x") for i in range(30)]
    finder = decontaminate.Finder(items, 0.1)
    for _ in range(60):
        parts = []
        for _ in range(3):
            t = list(rng.choice(items)[1])
            for _ in range(rng.randrange(8)):
                k = rng.randrange(len(t) + 1)
                t[k : k + rng.randrange(2)] = rng.choice(["", "q", "a"])
            parts.append("".join(t))
        text = " zz ".join(parts)
        plain = decontaminate.plain(text)
        want = {i: d for i, t in items if (d := distance_within(t, plain)) <= int(len(t) * 0.1 + 1e-9)}
        assert dict(finder.found(text)) == want


def test_frames_round_trip_and_show_damage():
    rows = [(1, [5, 6, 2]), (None, [2]), (-3, list(range(300)))]
    for wide in (False, True):
        data = b"".join(record_files.framed(k, np.array(x, "u4"), wide) + b"\n" for k, x in rows)
        assert [(k, ids.tolist()) for _, k, ids in record_files.records(memoryview(data))] == rows
        for at in (0, 9, 14, len(data) - 3):
            bad = bytearray(data)
            bad[at] ^= 1
            with pytest.raises((ValueError, struct.error)):
                list(record_files.records(memoryview(bytes(bad))))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit(lengths):
    x = np.array(lengths, "i8")
    bins, places = packing.best_fit_decreasing(x, 50)
    for b in set(bins.tolist()):
        mine = sorted(zip(places[bins == b].tolist(), x[bins == b].tolist(), strict=True))
        assert [p for p, _ in mine] == np.cumsum([0] + [n for _, n in mine])[:-1].tolist() and sum(n for _, n in mine) <= 50
    n = len(set(bins.tolist()))
    assert packing.lower_bound(x, 50) <= n <= max(1, math.ceil(1.5 * packing.lower_bound(x, 50))) or not lengths


def test_lower_bound_is_met_by_every_packing():
    assert packing.lower_bound(np.array([26] * 7), 50) == 7
    assert packing.lower_bound(np.array([17] * 9), 50) == 5
    assert packing.lower_bound(np.array([], "i8"), 50) == 0


def test_cuts():
    assert packing.cuts(1024, 1024) == [(0, 1024)]
    assert packing.cuts(1, 1024) == [(0, 1)]
    assert packing.cuts(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]


def test_exchange_puts_like_words_together():
    # words 0-3 follow 4-7 and the other way round
    b = np.zeros((8, 8))
    b[:4, 4:], b[4:, :4] = 10, 10
    of = brown_lm.exchange(b, 2)
    assert len(set(of[:4])) == len(set(of[4:])) == 1 and of[0] != of[4]


def test_heavy_hitters_keep_what_is_frequent():
    found = collections.Counter({"a": 100, "b": 50, "c": 1, "d": 1})
    assert set(token_counts._pruned(found, 2)) == {"a", "b"}


def test_shifts_cover_the_pass_join_windows():
    assert [list(line_dedup.shifts(i, d, 2)) for d in range(3) for i in range(3)] == [[0], [-1, 0, 1], [0], [0], [0, 1], [1], [0], [1], [2]]
    assert zlib.crc32(b"x") == 0x8CDC1683


def test_pieces_of_the_texts_at_hand_outlast_a_full_cache():
    e, asked = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), 6), []
    learn = e._learn
    e._learn = lambda missing: asked.append(sorted(missing)) or learn(missing)
    first = e.ids(["one two three four"])[0]
    e.ids(["one two five six seven"])  # more than fit: what these texts hold stays
    assert asked[1] == [" five", " seven", " six"]
    assert e.ids(["one two three four"])[0].tolist() == first.tolist()
