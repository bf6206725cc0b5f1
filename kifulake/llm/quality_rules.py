"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

The trees are grown here on labelled rows: Newton boosting of the logistic loss on
quantile bins. Chosen features are monotone: no split may let the score rise with them
(bounds handed down the tree keep that across levels). The trees are then flattened into
numpy node arrays and a batch is scored level by level, with no loop over documents.

Base rules: under 50 words, or over half the words in repeated three-word windows, fail.
A text is kept if it passes them and the trees give it at least ``threshold``. With no
usable labels (none, or of one class alone) the base rules decide by themselves.

Ids are compared as text, so they may be of any type. Null text counts as empty (so it
fails); very long texts are taken whole; repeated rows are judged each; ties between splits
go to the first feature, then the lowest cut; labels whose
doc_id or quality is null are ignored; where labels disagree the least quality counts;
an empty table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .text_stats import COLUMNS, statistics

FEATURES = ("log_words", "mean_word", "symbols_per_word", "symbols_per_char", "dup_line_share", "repeat_share", "words_per_line", "marks_per_word")
#: -1: the score never rises with the feature.
MONOTONE = {"symbols_per_word": -1, "symbols_per_char": -1, "repeat_share": -1}
#: The most labelled documents that the fit uses: those with the least hash of doc_id. Rows that
#: share a doc_id count as the one with the least statistics.
FIT_ROWS = 20_000


def features(stats: np.ndarray) -> np.ndarray:
    n, chars, symbols, dups, repeats, lines, marks = stats.T.astype("f8")
    words = np.maximum(n, 1)
    return np.stack([np.log1p(n), chars / words, symbols / words, symbols / np.maximum(chars, 1), dups / np.maximum(lines, 1), repeats / words, n / np.maximum(lines, 1), marks / words], axis=1)


@dataclass
class Trees:
    """All trees' nodes in a row: roots[t] is tree t's first node. A leaf's children are
    the leaf itself, so that ``depth`` steps end in a leaf on every path."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for the rows of x."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 8) -> Trees:
    """y: 0 or 1. least: rows that a leaf has at least."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    signs = [MONOTONE.get(n, 0) for n in FEATURES][: x.shape[1]] + [0] * max(0, x.shape[1] - len(FEATURES))
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    raw = np.full(len(y), start)
    roots, nodes = [], []  # node: feature, cut, left, right, value

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        here = len(nodes)
        leaf = lambda a, b: float(np.clip(-a / (b + ridge), low, high))
        nodes.append([0, 0.0, here, here, leaf(g[rows].sum(), h[rows].sum()) * rate])
        best, gs, hs = None, g[rows].sum(), h[rows].sum()
        if level < depth and len(rows) >= 2 * least:
            for f, e in enumerate(edges):
                b = binned[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(b, weights=w, minlength=len(e) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                if not len(gl):
                    continue
                lv, rv = (np.clip(-a / (c + ridge), low, high) for a, c in ((gl, hl), (gs - gl, hs - hl)))
                gain = -(gl * lv + (hl + ridge) * lv**2 / 2) - ((gs - gl) * rv + (hs - hl + ridge) * rv**2 / 2)
                gain[(nl < least) | (len(rows) - nl < least) | (signs[f] * (rv - lv) < 0)] = -np.inf
                k = int(np.argmax(gain))
                if np.isfinite(gain[k]) and (best is None or gain[k] > best[0]):
                    best = (gain[k], f, k, lv[k], rv[k])
        if best and best[0] > gs**2 / (2 * (hs + ridge)) + 1e-9:
            _, f, k, lv, rv = best
            middle, under = (lv + rv) / 2, binned[rows, f] <= k
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[f]]
            nodes[here][:2] = f, float(edges[f][k])
            nodes[here][2] = grow(rows[under], g, h, level + 1, *bounds[0])
            nodes[here][3] = grow(rows[~under], g, h, level + 1, *bounds[1])
        return here

    def made() -> Trees:
        f, c, a, b, v = zip(*nodes, strict=True)
        return Trees(np.array(roots), np.array(f), np.array(c), np.array(a), np.array(b), np.array(v), depth, start)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        at, f, c, a, b, v = np.full(len(y), first), *map(np.array, zip(*nodes, strict=True))
        for _ in range(depth):
            at = np.where(x[np.arange(len(y)), f[at]] <= c[at], a[at], b[at])
        raw = raw + v[at]
    return made()


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text") -> Trees | None:
    """Fits trees to the quality labels of at most so many documents; None: nothing to learn from."""
    named = labels.select(F.col("doc_id").cast("string").alias("of"), F.col("quality").cast("int").alias("y")).where("of is not null and y in (0, 1)")
    chosen = named.groupBy("of").agg(F.min("y").alias("y")).orderBy(F.xxhash64("of"), "of").limit(rows)
    both = docs.select(docs[doc_id].cast("string").alias("of"), docs[text].cast("string").alias("text")).join(F.broadcast(chosen), "of").select("of", "y", "text")

    def count(batches):
        for part, texts in slices(batches, "text"):
            s = statistics(texts)
            yield pa.RecordBatch.from_arrays([part.column("of"), part.column("y"), *[pa.array(c) for c in s.T]], ["of", "y", *COLUMNS])

    counted = both.mapInArrow(count, "of string, y int, " + ", ".join(f"{c} long" for c in COLUMNS))
    found = counted.groupBy("of").agg(F.min(F.struct(*COLUMNS, "y")).alias("x")).select("x.*").toPandas()  # ``rows`` at most
    found = found.sort_values([*COLUMNS, "y"], ignore_index=True)  # sums of the fit don't depend on the order of tasks
    y = found["y"].to_numpy("f8")
    return fit(features(found[list(COLUMNS)].to_numpy("i8")), y) if len(y) and 0 < y.sum() < len(y) else None


def assess(docs: DataFrame, trees: Trees | None, threshold: float = 0.5, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns to carry, the statistics, base_failed, score (null where there are no trees), kept."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # some thousand nodes, whatever the input
    names = [*carry, *COLUMNS[:5], "base_failed", "score", "kept"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[c] for c in carry))

    def apply(batches):
        model = shared.value
        for part, texts in slices(batches, text):
            s = statistics(texts)
            failed = (s[:, 0] < 50) | (100 * s[:, 4] > 50 * s[:, 0])
            score = model.score(features(s)) if model else None
            kept = ~failed & (score >= threshold) if model else ~failed
            columns = [*(part.column(c) for c in carry), *(pa.array(c) for c in s.T[:5]), pa.array(failed), pa.array(score, pa.float64()) if model else pa.nulls(len(s), pa.float64()), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, names)

    wanted = [*dict.fromkeys([*carry, text])]
    return docs.select(*wanted).mapInArrow(apply, f"{kinds}, {', '.join(f'{c} long' for c in COLUMNS[:5])}, base_failed boolean, score double, kept boolean")
