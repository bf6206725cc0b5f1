"""What the corpus operators share: tables, the shared scratch folder, row numbers, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of some 30 bytes that a join may broadcast; their number is checked, more are shuffled.
BROADCAST = 300_000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where the session has none, a session on one machine alone (tests) gets one; on a
    cluster that is an error, as scratch tables would go to the driver's own disk.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"/tmp/kifulake-{uuid.uuid4().hex}")
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get().rstrip("/")


def _store(spark: SparkSession, path: str):
    """A path of the store it is in, and that store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, in a folder that goes when the application ends."""
    own = f"{shared_dir(spark)}/kifulake-{spark.sparkContext.applicationId}"
    at, store = _store(spark, own)
    if not store.exists(at):
        store.mkdirs(at)
        store.deleteOnExit(at)
    return f"{own}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """Cuts lineage through a Parquet table in the shared folder, so a lost executor
    costs a re-read, not a re-computation, and row numbers given before stay fixed. The
    shuffle files that made it go once it is written. rows: that go to a Python worker at once."""
    path, conf = scratch(df.sparkSession, what), df.sparkSession.conf
    now = {CLEANUP: "true"} | ({BATCH: str(rows)} if rows else {})
    before = {k: conf.get(k) for k in now}
    try:
        for k, v in now.items():
            conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            conf.set(k, v)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def in_small_batches(f: Callable) -> Callable:
    """f, whose first argument is a frame; while it runs, rows go to Python workers by 4 MB at
    most (a row at least). The executor's JVM builds each batch outside its heap, doubling it as
    it grows, and the worker holds it whole: 10,000 texts, Spark's default, are 35 MB and more."""

    @wraps(f)
    def run(df: DataFrame, *args, **named):
        conf = df.sparkSession.conf
        before = conf.get(BATCH_BYTES, None)
        conf.set(BATCH_BYTES, "4m")
        try:
            return f(df, *args, **named)
        finally:
            conf.unset(BATCH_BYTES) if before is None else conf.set(BATCH_BYTES, before)

    return run


def discard(*frames: DataFrame) -> None:
    """Deletes tables of ``saved`` that no later result reads."""
    for df in frames:
        at, store = _store(df.sparkSession, df._scratch)
        store.delete(at, True)


def _scan(df: DataFrame) -> bool:
    """Whether each row of a frame is one row of a file."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns f and r, which name a row in every scan alike, however files are
    split: a hash of its file's path and its place there. The other columns are renamed to
    c0, c1 ..., so nothing clashes with them; the second result gives the new name of each.
    Frames that aren't scans of files are saved first."""
    if not _scan(docs):
        docs = saved(docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), "rows").toDF(*docs.columns)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = plain.metadataColumn("_metadata")
    return plain.select(F.xxhash64(at["file_path"]).alias("f"), at["row_index"].alias("r"), *plain.columns), {n: f"c{i}" for i, n in enumerate(docs.columns)}


def small(df: DataFrame) -> DataFrame:
    """A frame of some numbers a row, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def text_of(df: DataFrame, name: str = "text") -> Column:
    """A text column as string; null counts as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def offsets(texts: pa.Array) -> np.ndarray:
    """Where each text of a string or binary array starts in its buffer, and the last one ends."""
    kind = "i8" if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else "i4"
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, kind)


def parts(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about so many bytes of text each, so that what a worker
    holds does not depend on Spark's batch size."""
    for batch in batches:
        texts, start = batch.column(column), 0
        ends = offsets(texts)
        while start < batch.num_rows:
            stop = min(max(start + 1, int(ends.searchsorted(ends[start] + size))), start + 4096, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # the worker stays, for tasks of other stages too


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The same, each with its texts; null text counts as empty."""
    for part in parts(batches, column, size):
        yield part, [x or "" for x in part.column(column).to_pylist()]
