"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row of docs, and returns a
DataFrame that is written as Parquet and read again as the next stage's docs. All but
the last return the columns of ``documents``; extra columns of docs are carried along.

An empty table passes through all stages as an empty one. Null text counts as empty, so
the first stage rejects it. Rows of equal doc_id are documents of their own throughout.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kifulake.llm import bagminhash, decontaminate, line_dedup, packing, quality_rules
from kifulake.llm.common import saved, table

END = 2
#: Pieces of text that a packing worker keeps and bytes that it encodes together: fewer than where packing
#: runs alone, as the stages before it have filled the executors' heaps.
KEPT, PART = 150_000, 1 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the boosted trees keep."""
    trees = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # the columns added can't clash with these
    at = {n: f"c{i}" for i, n in enumerate(names)}
    judged = quality_rules.assess(plain, trees, carry=tuple(plain.columns), text=at["text"])
    return judged.where("kept").select(*[F.col(c).alias(n) for n, c in at.items()])


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that came before; those left without a line go."""
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return bagminhash.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and its place there."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), END, kept=KEPT, part_size=PART)


STAGES = [("quality", quality), ("line_dedup", line_repeats), ("near_dedup", near_duplicates), ("decontaminate", benchmark_leaks), ("packing", packed)]

#: No SQL expresses the trees or the tokenizer: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
