"""The corpus operators as registered queries, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, brown_lm, chat_format, collocations, decontaminate, filter_audit, line_dedup, packing, quality_rules, record_files, sentence_pieces, token_counts, url_filter
from .common import scratch, table
from .oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]

END = 2
RULES = [url_filter.Rule(*r) for r in (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))]
PROBE = "\\### Assistant: </turn> ok"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document. members: for each line that is a copy or has links
    "line=document:line of its first occurrence", on that one "~" and the linked lines."""
    found = line_dedup.line_report(table(spark, sf_dir, "documents"))
    at = lambda x: F.concat(F.coalesce(x["doc_id"].cast("string"), F.lit("")), F.lit(":"), x["n"].cast("string"))
    others = lambda m: F.coalesce(F.concat(F.lit("~"), F.array_join(F.transform(m["others"], at), " ")), F.lit(""))
    members = F.transform("members", lambda m: F.concat(m["n"].cast("string"), F.lit("="), at(m["first"]), others(m)))
    return found.select("doc_id", "n_lines", "n_copies", "n_near", "n_links", F.array_join("removed", ",").alias("removed"), F.array_join(members, ";").alias("members"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.assess(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def op3_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_classes(table(spark, sf_dir, "documents"))


def op4_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return brown_lm.score(docs, *brown_lm.learn(docs.where(~brown_lm.held_out(docs["doc_id"]))))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("select * from values (-7L, 0L, 'user'), (-7L, 1L, 'assistant') as t(conv_id, turn, role)").withColumn("text", F.lit(PROBE))
    return chat_format.digest(rows.unionByName(probe))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op7_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = scratch(spark, "records")
    record_files.write_records(table(spark, sf_dir, "documents"), to, public_tokenizers.path("word_bpe_49k.json"), END)
    return record_files.read_index(spark, to).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each benchmark item that a document holds: doc_id, item_id, edits."""
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("hits"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))



def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(sentence_pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality_rules, op3_bagminhash, op4_brown_lm, op5_chat_format, op6_url_filter, op7_record_files, op8_decontaminate, op9_packing, op10_token_counts, op11_filter_audit, op12_collocations, op13_sentence_pieces)}
