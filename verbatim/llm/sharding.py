"""Sharding: a Feistel permutation with cycle walking over global row numbers. DataFrame and SQL only."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import number_rows

ROUNDS = 6


def _domain(rows: int) -> tuple[int, int]:
    """Two factors whose product is at least `rows` and exceeds it by less than the smaller one."""
    a = max(1, isqrt(max(rows - 1, 0)) + 1 if rows > 1 else 1)
    return a, max(1, -(-rows // a))


def permuted(column: str, rows: int, seed: int) -> str:
    """SQL for one pass of an alternating Feistel network over [0, a * b).

    Even rounds shift the left half (modulo a) by a hash of the right one, odd rounds the right
    half (modulo b) by a hash of the left one; each round can be undone, so a pass is a bijection.
    """
    a, b = _domain(rows)
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', {column} div {b}L, 'r', {column} % {b}L), (s, k) -> "
        f"if(k % 2 = 0, named_struct('l', (s.l + pmod(xxhash64(s.r, k, {seed}L), {a}L)) % {a}L, 'r', s.r), "
        f"named_struct('l', s.l, 'r', (s.r + pmod(xxhash64(s.l, k, {seed}L), {b}L)) % {b}L)), s -> s.l * {b}L + s.r)"
    )


def walks_needed(spark: SparkSession, rows: int, seed: int) -> int:
    """Passes after which every row number has come back below `rows`.

    A walk leaves [0, rows) only for one of the fewer than sqrt(rows) + 1 numbers of the domain above
    it, so following those few is enough for the exact bound.
    """
    a, b = _domain(rows)
    passes, outside = 1, spark.range(rows, a * b)
    while not outside.isEmpty():
        outside = outside.select(F.expr(permuted("id", rows, seed)).alias("id")).where(F.col("id") >= rows)
        passes += 1
    return passes


def shuffle_positions(df: DataFrame, rows: int, seed: int, column: str = "row_number") -> DataFrame:
    """Adds `position`: the row number's place in a reproducible shuffle of [0, rows)."""
    out = df.withColumn("position", F.expr(permuted(column, rows, seed)))
    for _ in range(walks_needed(df.sparkSession, rows, seed) - 1):
        out = out.withColumn("position", F.expr(f"if(position < {rows}L, position, {permuted('position', rows, seed)})"))
    return out


#: Columns whose order numbers the rows.
ORDER = ["doc_id", "text_crc32", "size"]


def _keys() -> list[Column]:
    return [
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    ]


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 20260101) -> DataFrame:
    """Puts every row into one of `shards` shards whose row counts differ by one at most.

    Row numbers follow (doc_id, crc32 of the text, size, place in the input), nulls first; the
    permuted number p gives shard p % shards and slot p div shards, so either can be computed from
    the row number, the number of rows and the seed.
    Defined results: null text counts as empty (size 1, crc32 0); null doc_ids are kept; repeated
    rows get places of their own; an empty table gives an empty result; other columns are ignored.
    """
    numbered, rows = number_rows(docs.select(*_keys()), ORDER)
    placed = shuffle_positions(numbered, rows, seed) if rows else numbered.withColumn("position", F.col("row_number"))
    return placed.select(
        "doc_id", "size", "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("position") % shards).cast("int").alias("shard"),
        F.expr(f"position div {shards}L").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number", "position",
    )


def write_shards(assigned: DataFrame, docs: DataFrame, path: str, files_per_shard: int = 64) -> None:
    """Writes the documents by shard, each shard in `files_per_shard` files at most, slots ascending in a file.

    `assigned` is shard_documents(docs). The rows are numbered again in the same order, so every row,
    with or without a doc_id of its own, is written once, with a shard and slot that no other row has.
    """
    numbered, rows = number_rows(docs.select(*_keys(), F.struct(*docs.columns).alias("__row")), ORDER)
    if assigned.count() != rows:
        raise ValueError("assigned and docs differ in their rows")
    keyed = numbered.select("row_number", "__row").join(assigned.select("row_number", "shard", "slot"), "row_number").select("__row.*", "shard", "slot")
    part = F.expr(f"slot div 4096L % {files_per_shard}L")
    keyed.repartition("shard", part).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
