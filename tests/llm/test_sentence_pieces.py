"""SentencePiece: normal forms and spans against the library's, digests, round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from kifulake.llm import queries, sentence_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "　", "é", "é", "ﬁ", "Ⅳ", "李", "​", "\n", "\t", "A", "ｶ", "ﾞ", "㌀", "\x00", "½", "﻿", "▁", "<x>", "\xa0", "ẛ", "😀", "̈́", "ﷺ", "the ", "<s>", "</s>"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["", " ", "▁", "▁ ▁"] + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(n)]


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("flags", range(8))
def test_normal_form_and_alignment_are_the_librarys(rule, flags):
    options = dict(zip(("add_dummy_prefix", "remove_extra_whitespaces", "escape_whitespaces"), (bool(flags >> i & 1) for i in range(3)), strict=True))
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, **options)
    own = sentence_pieces.Normalizer(library.serialized_normalizer_spec())
    for text in texts(300, flags):
        want, places = library.Normalize(text, with_offsets=True)
        got, source = own.aligned(text.encode())
        # the library tells characters, the alignment bytes
        starts = [i for i, b in enumerate(got) if b & 0xC0 != 0x80] + [len(got)]
        chars = [len(text.encode()[: source[i]].decode()) for i in starts]
        assert (got.decode(), chars) == (want, list(places)), (text, options)


def test_symbols_of_the_author_stay_as_they_are():
    own = sentence_pieces.Normalizer(sentencepiece.SentencePieceNormalizer(rule_name="nfkc").serialized_normalizer_spec(), ["Ⅳ".encode(), "Ⅳﬁ".encode()])
    assert own.aligned("ⅣﬁⅣﬁﬁ".encode())[0].decode().endswith("ⅣﬁⅣﬁfi")


def test_spans_are_the_librarys():
    own = sentence_pieces.model(MODEL)
    for text, (ids, begins, ends) in zip(every := texts(1500, 9), own.encode(every), strict=True):
        want = [(x.id, x.begin, x.end) for x in own.library.encode(text, return_type="proto").pieces]
        assert list(zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True))[1:-1] == want, text
        assert ids.tolist() == own.library.encode(text, add_bos=True, add_eos=True)
        assert (ids[0], begins[0], ends[0]) == (1, 0, 0) and ids[-1] == 2 and begins[-1] == ends[-1] == len(text.encode())
        assert own.decode([ids.tolist()]) == [own.library.decode(ids.tolist())]


def test_spans_tile_the_text():
    own = sentence_pieces.model(MODEL)
    for text, (_, begins, ends) in zip(every := texts(300, 3), own.encode(every), strict=True):
        inner = slice(1, -1)
        assert b"".join(text.encode()[a:b] for a, b in zip(begins[inner], ends[inner], strict=True)) == text.encode()


def test_rows(spark):
    long = "word 李 " * 200_000
    rows = [(1, "a  b", 1, 2), (1, "a  b", 1, 2), (None, "\x00 é", 3, 4), (2, None, None, 5), (3, "", 6, 7), (4, long, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, pieces int")
    found = sentence_pieces.encoded(docs, MODEL, carry=("doc_id", "ids"))
    assert found.columns == ["doc_id", "ids", "pieces", "decoded"]
    got = sorted((tuple(r) for r in sentence_pieces.digests(found).collect()), key=str)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for doc, text, extra, _ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((doc, extra, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert sentence_pieces.digests(sentence_pieces.encoded(docs.limit(0), MODEL)).collect() == []
    bare = sentence_pieces.encoded(docs.where("doc_id = 2"), MODEL, begin=False, end=False).first()
    assert (bare.pieces.ids, bare.decoded) == ([], "")


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts_of = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op13_sentence_pieces(spark, sf).collect()
    assert len(rows) == len(texts_of)
    for r in rows:
        ids = library.encode(texts_of[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
