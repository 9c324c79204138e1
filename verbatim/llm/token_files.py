"""Token-id files: whole texts to ids, Simple-8b images in ascending doc_id order, and back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, slices, small_batches, work_path
from .simple8b import DOC, read_image, write_image
from .tokens import drop_encoders, encoder

#: Ids after which an image is closed; one longer document makes one longer image.
IMAGE_IDS = 1 << 17
#: Bytes of text that are encoded at a time: an image's arrays then stay in a processor's cache.
SLICE_BYTES = 1 << 19
FILE_SCHEMA = "file_id int, image_id int, ids_before long, n_ids long, image binary"
TOKEN_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, image_ids: int = IMAGE_IDS) -> None:
    """Writes every text's ids, `end_id` behind each document, as images in ascending doc_id order.

    One task, one file; each row of a file is one image of whole documents (simple8b). Spark's own
    writer commits the files, so any file system that Spark writes will do and a lost executor only
    repeats its tasks. Null text is an empty document; null doc_ids come first and stay null; equal
    doc_ids follow each other by their text's hash; an empty table gives no image; other columns are
    ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer), TaskContext.get().partitionId()
        held, image_id, before = [], 0, 0

        def image() -> pa.RecordBatch:
            nonlocal held, image_id, before
            table, ids = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            row = [[task], [image_id], [before], [len(ids)], [write_image(table, ids)]]
            held, image_id, before = [], image_id + 1, before + len(ids)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["file_id", "image_id", "ids_before", "n_ids", "image"])

        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                coded = enc.encode(part.column("text").to_pylist(), end_id)
                ids = np.frombuffer(b"".join(coded), "<u4")
                table = np.zeros(part.num_rows, DOC)
                table["doc_id"] = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
                table["null"] = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                table["n"] = [len(x) // 4 for x in coded]
                held.append((table, ids))
                if sum(len(x) for _, x in held) >= image_ids:
                    yield image()
        if held:
            yield image()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("__hash", F.xxhash64("text"))
        .repartitionByRange(partitions(spark), "doc_id", "__hash")
        .sortWithinPartitions("doc_id", "__hash")
        .select("doc_id", "text")
    )
    ordered.mapInArrow(encode, FILE_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids before it), n_tokens and ids_crc32."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    sizes = files.groupBy("file_id").agg(F.sum("n_ids").alias("n"))  # one row a file, that is a task of the writer
    bases = sizes.selectExpr("file_id", "coalesce(sum(n) OVER (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS base")
    based = files.join(F.broadcast(bases), "file_id").select((F.col("base") + F.col("ids_before")).alias("start"), "image")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()
        for batch in batches:
            for start, image in zip(batch.column("start").to_pylist(), batch.column("image"), strict=True):
                docs, ids = read_image(image.as_buffer())
                ends = np.cumsum(docs["n"].astype(np.int64))
                starts = ends - docs["n"]
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs["doc_id"], mask=docs["null"] > 0), pa.array(starts + start), pa.array(docs["n"].astype(np.int64)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # an image is some hundred kilobytes
    return based.mapInArrow(decode, TOKEN_SCHEMA)


def token_files(docs: DataFrame) -> DataFrame:
    """Writes the files into the shared folder and reads them back."""
    path = work_path(docs.sparkSession, "tokens")
    write_token_files(docs, path)
    return read_token_files(docs.sparkSession, path)
