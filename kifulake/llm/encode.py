"""Exact tokenisation by cached pieces.

A tokenizer never joins characters across the boundaries of its pre-tokenizer, so the
ids of a text are the ids of its pieces, one after the other. The pieces repeat; a
worker keeps those it has met, up to a bound, and calls the library for the rest.
Which boundaries are safe depends on the pre-tokenizer:

* byte-level (white space belongs to the word after it): before a blank or newline that
  follows a character other than white space;
* word-end (white space is dropped): any white space.

A text that holds a control character which Python and the library class differently,
or a special token's string, goes to the library whole. So does every text of a
tokenizer that is neither of the two.
"""

from __future__ import annotations

import gc
import json
import os
import re
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The pre-tokenizer patterns for which the boundaries above hold.
WORD_END_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Python takes these four for white space; the libraries do not.
UNSURE = ("\x00", "\x1c", "\x1d", "\x1e", "\x1f")
WIDE_SPACE = re.compile("[\x85\xa0  -     　]")
RUNS = re.compile(r"\s*\S+|\s+")
#: A word of letters, then ASCII punctuation: the two are pre-tokens of their own.
WORD_MARKS = re.compile(r"([ \n]?)([^\W\d_]+)([!-/:-@\[-`{-~]*)\Z")


def family(path: str) -> str:
    """byte, word or whole: which piece boundaries are safe for this tokenizer."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec["model"].get("type", "BPE") != "BPE" or spec["model"].get("dropout") or spec.get("truncation") or spec.get("padding"):
        return "whole"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "byte"
    parts = pre.get("pretokenizers", [])
    kinds = [x["type"] for x in (norm or {}).get("normalizers", [])]
    if kinds == ["NFC", "Replace", "Lowercase"] and len(parts) == 2 and parts[0].get("pattern") == {"Regex": WORD_END_PATTERN} and parts[0].get("invert"):
        return "word"
    return "whole"


#: Characters of a piece above which it is encoded anew each time.
LONGEST = 64
#: Pieces that a worker keeps: some 0.4 kB each.
MOST = 600_000


@contextmanager
def uncollected():
    """Without the garbage collector, which would walk the kept pieces again and again; nothing made here is cyclic."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class PieceEncoder:
    """ids(texts): for each text its ids as a uint32 array;
    lengths(texts): for each text the number of its ids.

    most: pieces kept at once, of ``LONGEST`` characters or fewer (text without blanks is one
    long piece that hardly comes again). known: (piece, number of ids) pairs kept from the start,
    for lengths() alone.
    """

    def __init__(self, path: str, most: int = MOST, known: dict[str, int] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.kind, self.most = Tokenizer.from_file(path), family(path), most
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.base = known
        self.kept: dict = dict(known or {})
        self.counting = known is not None

    def _direct(self, texts: list[str]) -> list:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [len(x) if self.counting else np.array(x.ids, "<u4").tobytes() for x in found]

    def _cut(self, text: str) -> str | None:
        """The text with a null character at each safe boundary; None: it goes to the library whole."""
        if self.kind == "whole" or any(c in text for c in UNSURE) or any(s in text for s in self.special):
            return None
        plain = "\t" not in text and "\r" not in text and "\x0b" not in text and "\x0c" not in text and (text.isascii() or not WIDE_SPACE.search(text))
        if self.kind == "word":
            return text.replace("\n", "\x00").replace(" ", "\x00") if plain else "\x00".join(text.split())
        if plain and not any(x in text for x in ("  ", " \n", "\n ", "\n\n")):
            return text.replace(" ", "\x00 ").replace("\n", "\x00\n")
        return "\x00".join(RUNS.findall(text))

    def _words(self, words: list[str]) -> dict:
        """Words of letters, each a single pre-token, encoded many to a call."""
        out: dict = {}
        if self.kind == "byte":
            bare = [w for w in words if w[0] != " "]
            out.update(zip(bare, self._direct(bare), strict=True))
            words, joint = [w for w in words if w[0] == " "], ""
        else:
            joint = " "
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        for group, found in zip(groups, self.library.encode_batch([joint.join(g) for g in groups], add_special_tokens=False), strict=True):
            owner = np.array(found.word_ids, "f8")  # None: not a number, which fails every comparison
            if len(owner) == 0 or owner[-1] + 1 != len(group) or not (np.diff(owner, prepend=0) >= 0).all():
                out.update(zip(group, self._direct(group), strict=True))
                continue
            cuts = np.searchsorted(owner, np.arange(len(group) + 1)).tolist()
            raw = np.array(found.ids, "<u4").tobytes()
            out.update((w, b - a if self.counting else raw[4 * a : 4 * b]) for w, a, b in zip(group, cuts, cuts[1:], strict=False))
        return out

    def _learn(self, missing: list[str]) -> list[str]:
        """Encodes these pieces; all that is kept now but shall not stay."""
        kept = self.kept
        words, rest, joined = set(), set(), []
        for piece in missing:
            if piece.isalpha() or (piece[:1] == " " and piece[1:].isalpha()):  # most are, and need no pattern
                words.add(piece)
                continue
            m = WORD_MARKS.match(piece)
            if not m:
                rest.add(piece)
                continue
            lead, word, marks = m.groups()
            if lead == "\n":
                rest.add(lead)
            elif lead:
                word = lead + word
            words.add(word)
            if marks:
                rest.add(marks)
            if word is not piece and word != piece:
                joined.append((piece, lead if lead == "\n" else "", word, marks))
        kept.update(self._words([x for x in words if x not in kept]))
        new = [x for x in rest if x not in kept]
        kept.update(zip(new, self._direct(new), strict=True))
        for piece, lead, word, marks in joined:
            value = kept[word]
            if lead:
                value = kept[lead] + value
            kept[piece] = value + kept[marks] if marks else value
        return [x for x in (*words, *rest, *missing) if len(x) > LONGEST]

    def _looked_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list, list[bool]]:
        """Of all pieces of the texts that can be cut: each one's number among the distinct
        ones, how many pieces each text has, the distinct ones' values; and which texts those are."""
        cut = [self._cut(t) for t in texts]
        whole = [c is None for c in cut]
        joined = [c for c in cut if c is not None]
        found = pc.split_pattern(pa.array(["\x00".join(joined)], pa.large_string()), "\x00").flatten().dictionary_encode()
        names = found.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes an Arrow scalar for each
        values = list(map(self.kept.get, names))
        missing = [x for x, v in zip(names, values, strict=True) if v is None]
        if missing:
            if len(self.kept) + len(missing) > self.most:  # what these texts hold stays, so frequent pieces aren't encoded anew
                self.kept = dict(self.base or {}) | {x: v for x, v in zip(names, values, strict=True) if v is not None}
            long = self._learn(missing)
            values = [self.kept[x] if v is None else v for x, v in zip(names, values, strict=True)]
            for x in long:
                self.kept.pop(x, None)
        return found.indices.to_numpy(), np.array([c.count("\x00") + 1 for c in joined], "i8"), values, whole

    @uncollected()
    def lengths(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0, "i8")
        at, pieces, values, whole = self._looked_up(texts)
        out, direct = np.zeros(len(texts), "i8"), np.array(whole)
        if len(pieces):
            out[~direct] = np.add.reduceat(np.array(values, "i8")[at], np.cumsum(pieces) - pieces)
        out[direct] = self._direct([t for t, w in zip(texts, whole, strict=True) if w])
        return out

    @uncollected()
    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        at, pieces, values, whole = self._looked_up(texts)
        flat, each = np.frombuffer(b"".join(values), "<u4"), np.array([len(v) // 4 for v in values], "i8")
        n = each[at]
        ends = np.cumsum(n)
        every = flat[np.repeat((np.cumsum(each) - each)[at] - (ends - n), n) + np.arange(ends[-1])] if len(ends) else flat
        stops = ends[np.cumsum(pieces) - 1].tolist() if len(pieces) else []
        cached = iter([every[a:b] for a, b in zip([0, *stops], stops, strict=False)])
        direct = iter(self._direct([t for t, w in zip(texts, whole, strict=True) if w]))
        return [np.frombuffer(next(direct), "<u4") if w else next(cached) for w in whole]


@lru_cache(4)
def encoder(path: str, most: int = MOST) -> PieceEncoder:
    """One for each worker process and tokenizer."""
    return PieceEncoder(path, most)
