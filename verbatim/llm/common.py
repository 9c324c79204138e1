"""Helpers that the operators share: shared folders, bounded Arrow batches, global row numbers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark puts into one Arrow batch at most; with whole texts in the rows this bounds a worker's memory.
BATCH_ROWS = 512
#: Bytes of text that an operator works on at a time inside a batch (one longer text is worked on alone).
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where that is unset, in local mode, a temporary folder is made and set; a cluster must have one.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="verbatim-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder: cuts the lineage and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop the shuffle files of finished steps now, not at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Rows with whole texts: keep Arrow batches short (a session setting, read when the plan runs)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch whose texts hold about `most` bytes; whole rows always."""
    sizes = [len(x) if x is not None else 0 for x in _buffers(batch, column)]
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def _buffers(batch: pa.RecordBatch, column: str):
    return (x.as_buffer() if x.is_valid else None for x in batch.column(column))


def number_rows(df: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Adds `row_number` (long, gapless from 0 in the order of `keys`) and gives the number of rows.

    Only DataFrame operations. Rows are dealt by range over the keys and, last, their place in the
    input, so equal keys spread over tasks; the place inside a task comes from
    monotonically_increasing_id, and the number of rows before each task from one row a task.
    """
    spark, n = df.sparkSession, partitions(df.sparkSession)
    names = df.columns
    order: list[Column] = [F.col(k) for k in keys] + [F.col("__tie")]
    dealt = (
        df.withColumn("__tie", F.monotonically_increasing_id())
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .select(*names, F.monotonically_increasing_id().alias("__at"))
    )
    dealt = settle(dealt)
    at = dealt.withColumn("__task", F.shiftright("__at", 33)).withColumn("__local", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = at.groupBy("__task").agg(F.count(F.lit(1)).alias("__n"))  # one row a task: at most n
    before = counts.selectExpr("__task", "coalesce(sum(__n) OVER (ORDER BY __task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS __before", "__n")
    total = before.agg(F.sum("__n")).first()[0] or 0
    out = at.join(F.broadcast(before.drop("__n")), "__task").select(*names, (F.col("__before") + F.col("__local")).alias("row_number"))
    return out, int(total)
