"""The registered queries, with production parameters, over the smallest tables."""

import collections
import re

import duckdb
import pytest

import __spark_entry__
from kifulake.llm import chat_format, decontaminate, queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "conversations", "benchmark", "labels")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries()) and set(queries.ORACLE) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_rows_are_those_of_the_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert collections.Counter(tuple(r[c] for c in columns) for r in got.collect()) == collections.Counter(tuple(r[i] for i in at) for r in want.fetchall())


def test_probe_conversation_is_formatted_reversibly(spark):
    row = queries.op5_chat_format(spark, SF).where("conv_id = -7").first()
    assert (row.n_turns, row.loss_chars) == (2, len(queries.PROBE))
    import hashlib

    assert row.turns_sha256 == hashlib.sha256(f"user\n{queries.PROBE}\nassistant\n{queries.PROBE}\n".encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(queries.PROBE.encode()).hexdigest()
    assert chat_format.ASSISTANT == "assistant"


def test_matches_of_the_benchmark(spark, duck):
    got = {(r.doc_id, r.item_id): r.edits for r in queries.op8_decontaminate(spark, SF).collect()}
    docs, items = duck.sql("select doc_id, text from documents").fetchall(), duck.sql("select item_id, text from benchmark").fetchall()
    exact = {(d, i) for d, t in docs for i, x in items if x and decontaminate.plain(x) and decontaminate.plain(x) in decontaminate.plain(t or "")}
    assert exact == {k for k, e in got.items() if e == 0}


@pytest.mark.parametrize("name", ["op2_quality_rules", "op4_brown_lm", "op7_record_files", "op9_packing", "op10_token_counts"])
def test_the_rest_cover_every_document(spark, duck, name):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert {r.doc_id for r in rows} == {x for (x,) in duck.sql("select doc_id from documents").fetchall()}
    if name == "op2_quality_rules":
        n = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in duck.sql("select doc_id, text from documents").fetchall()}
        assert all(r.n_words == n[r.doc_id] and not (r.base_failed and r.kept) for r in rows)
    if name == "op4_brown_lm":
        held = [r for r in rows if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)  # the classes help on texts that they were not learned from
