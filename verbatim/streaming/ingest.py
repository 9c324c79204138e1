"""Incremental ingest: new text files or rows, tokenised without state, appended to a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.annotate import Annotator, WordOnly
from ..schema import CORPUS


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of documents from a folder of .txt files; the id is a hash of the path."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).load(path)
    return files.select(F.xxhash64("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def append_stream(docs: DataFrame, path: str, checkpoint: str, annotator: Annotator | None = None):
    """Appends all that is there and ends (trigger availableNow)."""
    out = (annotator or WordOnly()).annotate(docs).select(*[f.name for f in CORPUS.fields])
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
