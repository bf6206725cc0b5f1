"""Word and line statistics of whole texts, many texts to a numpy call."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: n_lines and n_marks beside the five that the contract names.
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks")


def repeated_words(words: np.ndarray, distinct: int) -> int:
    """Words that stand in a window of three which the text holds twice or more."""
    if len(words) < 4:
        return 0
    if distinct >= 1 << 20:
        words, distinct = np.unique(words, return_inverse=True)[1], len(words)
    keys = (words[:-2] * distinct + words[1:-1]) * distinct + words[2:] if distinct < 1 << 20 else None
    if keys is None:  # over a million distinct words: number the pairs first
        pairs = np.unique(words[:-1] * distinct + words[1:], return_inverse=True)[1]
        keys = pairs[:-1] * distinct + words[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def statistics(texts: list[str]) -> np.ndarray:
    """A row of COLUMNS for each text."""
    out = np.zeros((len(texts), len(COLUMNS)), "i8")
    split = [t.encode().split() for t in texts]  # bytes: just the six ASCII blanks split
    out[:, 0] = [len(w) for w in split]
    every = pa.array([w for ws in split for w in ws], pa.binary()).dictionary_encode()
    at, distinct, ends = every.indices.to_numpy().astype("i8"), max(1, len(every.dictionary)), np.cumsum(out[:, 0])
    for i, t in enumerate(texts):
        out[i, 1] = len(t) - sum(t.count(c) for c in SPACES)
        out[i, 2] = sum(t.count(c) for c in SYMBOLS)
        lines = [x for x in t.split("\n") if x.strip(SPACES)]
        out[i, 3] = len(lines) - len(set(lines))
        out[i, 4] = repeated_words(at[ends[i] - out[i, 0] : ends[i]], distinct)
        out[i, 5] = len(lines)
        out[i, 6] = t.count(".") + t.count(",") + t.count("!") + t.count("?")
    return out
