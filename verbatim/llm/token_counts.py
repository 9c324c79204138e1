"""Token counts by separator scan: end-of-document ids in flat, unindexed token files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, work_path
from .tokens import encoder

#: Ids of a block, whatever documents begin or end in it.
BLOCK_IDS = 1 << 18
KINDS = {"ids": 0, "names": 1}
SCHEMA = "kind int, file_id int, block_id int, payload binary"


def write_flat(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 50256) -> None:
    """Flat files of unsigned 16-bit ids, `end_id` behind each document, cut into blocks of BLOCK_IDS.

    The id is one that no text gives, as special tokens' strings in texts are encoded letter by letter. The files hold no index; beside each the documents' ids are
    kept in order, so that counts can be named. No shuffle: a task writes what it reads.
    """
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer, literal=True), TaskContext.get().partitionId()
        held, size, blocks, names = [], 0, 0, 0

        def row(kind: str, block: int, payload: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([KINDS[kind]], pa.int32()), pa.array([task], pa.int32()), pa.array([block], pa.int32()), pa.array([payload], pa.binary())], ["kind", "file_id", "block_id", "payload"])

        for batch in batches:
            for part in slices(batch, "text"):
                ids = np.frombuffer(b"".join(enc.encode(part.column("text").to_pylist(), end_id)), "<u4")
                held.append(ids.astype("<u2"))
                size += len(ids)
                if size >= BLOCK_IDS:
                    flat = np.concatenate(held)
                    for at in range(0, size - size % BLOCK_IDS, BLOCK_IDS):
                        yield row("ids", blocks, flat[at : at + BLOCK_IDS].tobytes())
                        blocks += 1
                    held, size = [flat[size - size % BLOCK_IDS :]], size % BLOCK_IDS
                known = part.column("doc_id")
                both = np.zeros(part.num_rows, [("id", "<i8"), ("null", "u1")])
                both["id"], both["null"] = known.fill_null(0).to_numpy(zero_copy_only=False), known.is_null().to_numpy(zero_copy_only=False)
                yield row("names", names, both.tobytes())
                names += 1
        if size:
            yield row("ids", blocks, np.concatenate(held).tobytes())

    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, SCHEMA)
    flat.write.option("compression", "zstd").parquet(path)


def scan_blocks(blocks: DataFrame, end_id: int = 50256) -> DataFrame:
    """Each block's number of ids and the places of the separators in it, found by one vector comparison."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, block_id, payload in zip(batch.column("file_id").to_pylist(), batch.column("block_id").to_pylist(), batch.column("payload"), strict=True):
                ids = np.frombuffer(payload.as_buffer(), "<u2")
                at = np.flatnonzero(ids == end_id).astype("<i4")
                last = int(at[-1]) if len(at) else None
                yield pa.RecordBatch.from_arrays([pa.array([file_id], pa.int32()), pa.array([block_id], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([last], pa.int64()), pa.array([at.tolist()], pa.list_(pa.int32()))], ["file_id", "block_id", "n", "n_ends", "last_end", "ends"])

    return blocks.mapInArrow(scan, "file_id int, block_id int, n long, n_ends long, last_end long, ends array<int>")


def stitch(scanned: DataFrame) -> DataFrame:
    """Per document of a file: file_id, doc_no (from 0), start and n_tokens with the separator.

    Prefix scans over a file's blocks: ids before a block, separators before it, and the place of the
    last separator before it, from which the document open at the block's start is counted.
    """
    before = "OVER (PARTITION BY file_id ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    placed = scanned.withColumn("base", F.expr(f"coalesce(sum(n) {before}, 0L)")).withColumn("docs_before", F.expr(f"coalesce(sum(n_ends) {before}, 0L)"))
    placed = placed.withColumn("open_from", F.expr(f"coalesce(max(base + last_end) {before}, -1L) + 1"))
    each = placed.select("file_id", "base", "docs_before", "open_from", F.posexplode(F.expr("transform(ends, (e, i) -> named_struct('e', e, 'p', if(i = 0, -1, get(ends, i - 1))))")).alias("i", "x"))
    start = F.when(F.col("i") == 0, F.col("open_from")).otherwise(F.col("base") + F.col("x.p") + 1)
    return each.select("file_id", (F.col("docs_before") + F.col("i")).alias("doc_no"), start.alias("start"), (F.col("base") + F.col("x.e") + 1 - start).alias("n_tokens"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """file_id, doc_no, doc_id of the flat files' documents."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, block_id, payload in zip(batch.column("file_id").to_pylist(), batch.column("block_id").to_pylist(), batch.column("payload"), strict=True):
                both = np.frombuffer(payload.as_buffer(), [("id", "<i8"), ("null", "u1")])
                ids = pa.array(both["id"].copy(), mask=both["null"] > 0)
                yield pa.RecordBatch.from_arrays([pa.array([file_id], pa.int32()), pa.array([block_id], pa.int32()), pa.array([len(both)], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64()))], ["file_id", "block_id", "n", "ids"])

    kept = spark.read.schema(SCHEMA).parquet(path).where(F.col("kind") == KINDS["names"]).select("file_id", "block_id", "payload")
    lists = kept.mapInArrow(read, "file_id int, block_id int, n long, ids array<long>")
    based = lists.withColumn("base", F.expr("coalesce(sum(n) OVER (PARTITION BY file_id ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)"))
    return based.select("file_id", "base", F.posexplode("ids").alias("i", "doc_id")).select("file_id", (F.col("base") + F.col("i")).alias("doc_no"), "doc_id")


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 50256) -> DataFrame:
    """Per document, from flat files: doc_id, n_tokens (without the separator), and file_id, doc_no, start there.

    Defined results: null or empty text has 0 tokens; null doc_ids and repeated rows are counted like
    others; a document longer than a block is stitched over all its blocks; an empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    path = work_path(spark, "flat")
    write_flat(docs, path, tokenizer, end_id)
    blocks = spark.read.schema(SCHEMA).parquet(path).where(F.col("kind") == KINDS["ids"]).select("file_id", "block_id", "payload")
    counted = stitch(scan_blocks(blocks, end_id))
    named = counted.join(read_names(spark, path), ["file_id", "doc_no"])
    return named.select("doc_id", (F.col("n_tokens") - 1).alias("n_tokens"), "file_id", "doc_no", "start")
