"""Text collections to documents(doc_id, path, text)."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DOCUMENT


def read_text_dir(spark: SparkSession, path: str) -> DataFrame:
    """Every regular file under `path` whose extension is exactly txt, one document each, ids from 0 by path.

    Local folders are listed on the driver, so names with a leading "_" are read too; files are read
    by the tasks. A file that is not UTF-8 fails the read. Other stores go through Spark's reader.
    """
    if "://" in path:
        return read_text_store(spark, path)
    if not os.path.isdir(path):
        raise FileNotFoundError(path)
    names = sorted(os.path.join(d, f) for d, _, files in os.walk(path) for f in files if f.endswith(".txt") and f != ".txt" and os.path.isfile(os.path.join(d, f)))
    if not names:
        return spark.createDataFrame([], DOCUMENT)

    @F.udf("string")
    def content(name: str) -> str:  # one call a file
        with open(name, "rb") as f:
            return f.read().decode("utf-8")

    listed = spark.createDataFrame(list(enumerate(names)), "doc_id long, path string").repartition(min(len(names), 64))
    return listed.select("doc_id", "path", content("path").alias("text"))


def read_text_store(spark: SparkSession, path: str) -> DataFrame:
    """The same from any store that Spark reads; ids are dense and follow the path. Decoding is strict."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    named = files.select("path", F.decode("content", "UTF-8").alias("text"))
    paths = named.select("path").orderBy("path").withColumn("doc_id", F.row_number().over(_by_path()).cast("long") - 1)
    return named.join(paths, "path").select("doc_id", "path", "text")


def _by_path():
    from pyspark.sql import Window

    return Window.orderBy("path")  # file names only


def from_table(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | Column | None = None) -> DataFrame:
    """Any table with an id and a text; extra columns stay for filters and groupings."""
    where = F.col(path) if isinstance(path, str) else path if path is not None else F.col(doc_id).cast("string")
    kept = [c for c in df.columns if c not in {doc_id, text, "path"}]
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), where.alias("path"), F.col(text).alias("text"), *kept)


def read_abbreviations(spark: SparkSession, path: str) -> list[str]:
    """One a line, trimmed; blank lines and comments dropped. A short list by its nature."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where((F.col("v") != "") & ~F.col("v").startswith("#"))
    return [r["v"] for r in lines.collect()]


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tagger's output, word TAB tag TAB lemma; lemma "<unknown>" or empty is null, lines without a tag are dropped."""
    part = F.split("value", "\t")
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.get(part, F.lit(0)).alias("word"), F.get(part, F.lit(1)).alias("pos"), F.get(part, F.lit(2)).alias("lemma"))
    return clean_tags(rows)


def clean_tags(rows: DataFrame) -> DataFrame:
    lemma = F.when(F.col("lemma").isin("", "<unknown>"), None).otherwise(F.col("lemma"))
    return rows.where(F.col("pos").isNotNull() & (F.col("pos") != "")).withColumn("lemma", lemma)
