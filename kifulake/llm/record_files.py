"""Token ids in length-delimited binary records, with a separate offset index.

A record is: length of the payload (8 bytes, little-endian), masked CRC-32 of those 8
bytes (4), payload, masked CRC-32 of the payload (4), one byte 0x0A. The payload is a
flag byte (1: the id is null; 2: ids take 4 bytes, else 2), the document's id (8), ids.
The mask is the usual one: rotate right by 15, add 0xa282ead8.

Shards are written by Spark's own text sink, whose rows are the framed records and whose
line ends are their last bytes: so they commit as any Spark output does, survive lost
executors, and go to any store that Spark writes. Shard k holds the k-th range of ids in
ascending order. The index (a Parquet table) gives each record's shard, offset, first
token and number of tokens, so that a reader can seek in any order.

Null text gives a record with the end id alone; a null id comes first; rows that share
an id follow each other in the order of their text's hash, then text; an empty table
gives an empty index; a very long text is one record like any other; columns other than the
two named are ignored. Ids must be whole numbers: a record has eight bytes for its id.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small, text_of
from .encode import encoder

#: Bytes of input for each shard, by Spark's estimate.
SHARD = 32 << 20
#: An estimate above this is counted instead.
KNOWN = 1 << 40
INDEX = "doc_id long, shard int, offset long, local_start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def framed(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    """All of a record but its last byte, which the sink writes."""
    payload = struct.pack("<Bq", (doc_id is None) | wide << 1, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def records(data: memoryview):
    """(offset, document id, ids) of each record of a shard; raises where a checksum differs."""
    at = 0
    while at < len(data):
        size, check = struct.unpack_from("<QI", data, at)
        if masked(bytes(data[at : at + 8])) != check:
            raise ValueError(f"the length at {at} is damaged")
        payload = data[at + 12 : at + 12 + size]
        if struct.unpack_from("<IB", data, at + 12 + size) != (masked(payload), 10):
            raise ValueError(f"the record at {at} is damaged")
        flags, doc_id = struct.unpack_from("<Bq", payload)
        yield at, None if flags & 1 else doc_id, np.frombuffer(payload[9:], "<u4" if flags & 2 else "<u2")
        at += 12 + size + 5


def write_records(docs: DataFrame, to: str, path: str, end_id: int) -> None:
    """Encodes all texts (each followed by end_id) and writes shards and index under ``to``."""
    spark = docs.sparkSession
    wide = max(encoder(path).library.get_vocab_size(), end_id + 1) > 1 << 16
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).withColumn("tie", F.xxhash64("text"))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > KNOWN:  # frames without file statistics, or behind joins, have made-up sizes
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]

    def frame(batches):
        for part, texts in slices(batches, "text", 4 << 20):
            keys, encoded = part.column("doc_id").to_pylist(), encoder(path).ids(texts)
            yield pa.RecordBatch.from_arrays([pa.array([framed(k, np.append(x, np.uint32(end_id)), wide) for k, x in zip(keys, encoded, strict=True)], pa.binary())], ["frame"])

    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    # mode: a shard folder that is there already is an error, as for any Spark table
    ordered.mapInArrow(frame, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("compression", "none").text(f"{to}/shards")
    _index(spark, to).write.parquet(f"{to}/index")


def _index(spark: SparkSession, to: str) -> DataFrame:
    """Reads all shards, checking every checksum."""

    def parse(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                shard, start, rows = int(re.search(r"part-(\d+)", name)[1]), 0, []
                for at, doc_id, ids in records(memoryview(data.as_buffer())):
                    rows.append((doc_id, shard, at, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.int32()] + [pa.int64()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "shard", "offset", "local_start", "n_tokens", "ids_crc32"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{to}/shards").select("path", "content").mapInArrow(parse, INDEX)


def read_index(spark: SparkSession, to: str) -> DataFrame:
    """The index with each record's first token counted from the start of all shards.

    The shards before a shard are summed up over one row for each shard, not over records;
    that is a row for each 32 MB of input, so the window and the broadcast stay small.
    """
    index = spark.read.schema(INDEX).parquet(f"{to}/index")
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = totals.selectExpr("shard as at", "coalesce(sum(n) over (order by shard rows between unbounded preceding and 1 preceding), 0L) as base")
    return index.join(small(before), index["shard"] == before["at"]).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "shard", "offset")
