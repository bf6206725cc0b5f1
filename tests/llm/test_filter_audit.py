"""The filter audit against a brute-force run of every order over every document."""

import itertools
import re

import numpy as np

from kifulake.llm import filter_audit

NAMES = "doc_id long, text string, lang string, part int, mask int, good int, digest int, id int, first int"


def brute(rows, labels):
    """{(part, order, step): COUNTS} by running each order of the filters."""
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    texts = [(i, t or "", p or "") for i, t, p in rows]

    def fails(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        e = i is not None and any(j is not None and j < i and u == t for j, u, _ in texts)
        return "".join(x for x, hit in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), e), strict=True) if hit)

    each = [(i, p, fails(i, t)) for i, t, p in texts]
    out = {}
    for part in {p for _, p, _ in each}:
        own = [(i, f) for i, p, f in each if p == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                removed, kept = [d for d in left if x in d[1]], [d for d in left if x not in d[1]]
                gone = [d for d in own if x in d[1] and set(d[1]) & set(order[: step - 1])]
                out[part, order, step] = [len(kept), len(removed), len(gone), sum(f == x for _, f in own), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)]
                shares[x] += len(removed)
                left = kept
        for order, step in {(o, s) for p, o, s in out if p == part}:
            out[part, order, step].append(shares[order[step - 1]])
    return out


def test_against_brute_force(spark):
    varied = " ".join(f"w{i}" for i in range(120))
    texts = [varied, varied, varied + " #", varied.upper(), "a b", "", None, "same " * 200, "same " * 200, varied + "\x1c\xa0é", " \n", "A" * 9 + "b" * 81, "A" * 10 + "b" * 90, varied, "x" * 500_000 + " $"]
    rows = [(i // 2 if i < 4 else i, t, (None, "", "de", "en")[i % 4]) for i, t in enumerate(texts)] + [(None, varied, "en"), (None, None, "en"), (3, "a b", "en")]
    labels = [(0, 1, 0), (0, 0, 1), (1, 1, None), (4, 1, 1), (9, None, None), (None, 1, 1), (99, 1, 1), (13, 1, 1)]
    docs = spark.createDataFrame([(*r, 0, 0, 0, 0, 0, 0) for r in rows], NAMES)
    found = filter_audit.audit(filter_audit.failures(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    got = {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.COUNTS] for r in found.collect()}
    assert got == brute(rows, labels) and len(got) == 3 * 600


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], NAMES), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.failures(docs, labels)).collect() == []
    one = spark.createDataFrame([(1, "a", "en", *[0] * 6)], NAMES)
    assert filter_audit.audit(filter_audit.failures(one, labels)).where("removed > 0").count() == 120


def test_matrices_split_every_mask():
    _, own, by = filter_audit.matrices()
    assert by["kept"].shape == (32, 600)
    fails = (np.arange(32)[:, None] >> own & 1) == 1
    assert ((by["removed"] + by["redundant"]) == fails).all() and not (by["kept"] * fails).any()
    # what an order removes in all its steps is every document that fails anything
    assert (by["removed"].reshape(32, 120, 5).sum(axis=2) == (np.arange(32) > 0)[:, None]).all()


def test_many_parts_go_through_in_stacks(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "STACK", 3)
    masks = spark.range(40).selectExpr("cast(id % 20 as string) as part", "cast(id % 32 as int) as mask", "1L as good", "0L as toxic")
    rows = filter_audit.audit(masks).where("filter_order = 'ABCDE' and step = 1").collect()
    assert sorted(int(r.part) for r in rows) == list(range(20)) and sum(r.kept + r.removed for r in rows) == 40
