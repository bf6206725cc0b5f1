"""What a worker holds at once: the functions that tasks run, on batches of their own."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
import public_tokenizers
from kifulake.llm import brown_lm, common, encode, packing, quality_rules, words


class Frame:
    """Keeps the function that mapInArrow gets."""

    schema = {c: SimpleNamespace(name=c, dataType=SimpleNamespace(simpleString=lambda k=k: k)) for c, k in (("doc_id", "long"), ("text", "string"))}

    def __init__(self):
        self.sparkSession = self.sparkContext = self
        self.broadcast = lambda x: SimpleNamespace(value=x)

    def __getitem__(self, name):
        return SimpleNamespace(cast=lambda _: SimpleNamespace(alias=lambda _: name))

    def select(self, *_):
        return self

    def mapInArrow(self, f, _):  # noqa: N802
        self.f = f
        return self


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])


@pytest.mark.parametrize("complete", [True, False])
def test_neighbours_take_under_64_bytes_a_token(complete):
    draw = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in draw.zipf(1.3, 500) % 50_000) for _ in range(1_500)]
    numbers, sizes = brown_lm.tokens(pa.array(texts))
    names, counts = np.unique(numbers, return_counts=True)
    known = (counts >= (2 if complete else 4)) | (names == brown_lm.END)
    model = brown_lm.Model(names[known], counts[known], (np.arange(known.sum()) % 64).astype("i4"), 65, complete)
    frame, n = Frame(), 0
    brown_lm.neighbours(frame, model)
    words._factors(1 << 20)  # kept from the first text on
    tracemalloc.start()
    for found in frame.f(iter([batch(texts)])):
        n += found.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n and peak < 64 * len(numbers), peak / len(numbers)


@pytest.mark.parametrize(("name", "complete"), [("neighbours", True), ("neighbours", False), ("class_bigrams", True)])
def test_brown_tasks_take_under_24_bytes_a_token(name, complete, monkeypatch):
    draw = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in draw.zipf(1.3, 500) % 50_000) for _ in range(6_000)]
    numbers = brown_lm.tokens(pa.array(texts))[0]
    names, counts = np.unique(numbers, return_counts=True)
    known = (counts >= (2 if complete else 4)) | (names == brown_lm.END)
    model = brown_lm.Model(names[known], counts[known], (np.arange(known.sum()) % 64).astype("i4"), 65, complete)
    frame, n = Frame(), len(numbers)
    if name == "neighbours":
        brown_lm.neighbours(frame, model)
    else:
        frame.groupBy = lambda *_: SimpleNamespace(agg=lambda _: SimpleNamespace(collect=list))
        monkeypatch.setattr(brown_lm, "F", SimpleNamespace(sum=lambda _: SimpleNamespace(alias=lambda _: None)))
        brown_lm.class_bigrams(frame, None, model)
    held = [batch(texts[i : i + 1_500]) for i in range(0, len(texts), 1_500)]
    del numbers, names, counts, known, texts
    words._factors(1 << 20)
    tracemalloc.start()
    rows = sum(x.num_rows for x in frame.f(iter(held)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows and peak < 24 * n, peak / n


def test_groups_hold_the_same_tokens(monkeypatch):
    texts = [f"a b{i % 7} " * (i % 5) + f"c{i}" * (i % 2) for i in range(300)]
    numbers, sizes = brown_lm.tokens(pa.array(texts))
    batches = [batch(texts[i : i + 40]) for i in range(0, 300, 40)]
    for group in (1, 900, 1 << 30):
        monkeypatch.setattr(brown_lm, "GROUP", group)
        found = [(names[at], n) for names, texts in brown_lm._groups(iter(batches)) for at, n in texts]
        assert np.concatenate([x for x, _ in found]).tolist() == numbers.tolist()
        assert np.concatenate([x for _, x in found]).tolist() == sizes.tolist()


@pytest.mark.parametrize("kind", ["i4", "i8"])
def test_runs_keep_a_words_keys_together(kind, monkeypatch):
    monkeypatch.setattr(brown_lm, "SLICE", 50)
    draw = np.random.default_rng(7)
    keys = [(draw.zipf(1.4, 400) % 60 * 10 + draw.integers(0, 10, 400)).astype(kind) for _ in range(3)]
    keys.append(np.full(5, (1 << 31) - 1, kind))
    want = np.unique(np.concatenate(keys), return_counts=True)
    found = list(brown_lm._runs(keys, 10))
    assert not keys and len(found) > 3
    assert [np.concatenate(x).tolist() for x in zip(*found, strict=True)] == [x.tolist() for x in want]
    groups = [set((x // 10).tolist()) for x, _ in found]
    assert sum(map(len, groups)) == len(set.union(*groups))
    assert list(brown_lm._runs([])) == []


def test_texts_go_to_a_worker_by_four_megabytes(spark, tmp_path):
    to = str(tmp_path / "documents.parquet")
    spark.range(3_000, numPartitions=1).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 500) as text").write.parquet(to)
    before = spark.conf.get(common.BATCH_BYTES, None)

    def held(batches):
        for x in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.num_rows]), pa.array([x.nbytes])], ["n", "bytes"])

    @common.in_small_batches
    def seen(docs):
        return docs.mapInArrow(held, "n long, bytes long").collect()

    rows = seen(spark.read.parquet(to))
    assert sum(r.n for r in rows) == 3_000 and max(r.bytes for r in rows) < 5 << 20
    assert spark.conf.get(common.BATCH_BYTES, None) == before
    assert all(f.__wrapped__ for f in (brown_lm.learn, brown_lm.score))


def test_joint_keys_do_not_overflow():
    a = np.array([0, 70_000, 99_999], "i4")
    small, large = brown_lm.joint(a, 130, a % 130, 100_000 * 130), brown_lm.joint(a, 100_000, a, 100_000**2)
    assert small.dtype == "i4" and large.dtype == "i8"
    assert small.tolist() == [x * 130 + x % 130 for x in a.tolist()]
    assert large.tolist() == [x * 100_001 for x in a.tolist()]


def test_quality_takes_a_megabyte_of_text_at_once(monkeypatch):
    seen, counted = [], quality_rules.statistics
    monkeypatch.setattr(quality_rules, "statistics", lambda texts: seen.append(sum(map(len, texts))) or counted(texts))
    frame = Frame()
    quality_rules.assess(frame, None)
    rows = sum(x.num_rows for x in frame.f(iter([batch(["some words here " * 600] * 400)])))
    assert rows == 400 and max(seen) < 1.1 * (1 << 20)


def test_the_pipeline_packs_small_parts_with_the_same_pieces(monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    path, texts, found = public_tokenizers.path("byte_bpe_50k.json"), [f"Line {i} of word{i}s, and {i * i}.\n" * (i % 90) for i in range(300)], []
    for bounds in ({}, {"kept": 50, "part_size": 1000}):
        frame = Frame()
        packing.cut_documents(frame, path, 2, 1024, **bounds)
        found.append([r for x in frame.f(iter([batch(texts)])) for r in x.to_pylist()])
    assert found[0] == found[1] and len(found[0]) > 300
    asked = {}
    monkeypatch.setattr(packing, "pack", lambda *a, **b: asked.update(b))
    corpus_pipeline.packed(None, None, "")
    assert asked["kept"] <= 150_000 and asked["part_size"] <= 1 << 20


def test_packing_worker_keeps_the_pieces_of_several_texts(monkeypatch):
    """Pieces that don't stay are encoded again and again, which is most of what packing costs."""
    learned = []
    own = encode.PieceEncoder._learn
    monkeypatch.setattr(encode.PieceEncoder, "_learn", lambda self, missing: learned.append(len(missing)) or own(self, missing))
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    texts = [" ".join(name(i) for i in range(a, a + 100_000)) for a in range(0, 400_000, 100_000)]
    encoder = encode.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), packing.KEPT)
    first = [encoder.ids([x])[0] for x in texts][0]
    assert len(learned) == 4
    assert (encoder.ids(texts[:1])[0] == first).all() and len(learned) == 4
    assert first.tolist() == encoder.library.encode(texts[0], add_special_tokens=False).ids
