"""Packing: shortest-pack-first over the histogram of lengths, then documents to packs by rank."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import number_rows, settle, slices, small_batches
from .tokens import encoder

LIMIT = 2048
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED_SCHEMA = f"{PIECE_SCHEMA}, sequence_id long, offset long"


def pack_histogram(histogram: dict[int, int], limit: int = LIMIT) -> tuple[dict[int, np.ndarray], int]:
    """Where the pieces of each length go: arrays (first rank, packs, first sequence, offset), ranks from 0.

    Lengths are placed longest first. A pattern is a list of lengths and a number of equal packs of
    them; the pattern with the shortest packs takes the next pieces if they fit, as many as it has
    packs (it is split in two when there are fewer), else a new pattern starts. The number of entries
    depends on the histogram, of `limit` bins, and hardly on the counts.
    """
    heap: list[tuple[int, int]] = []  # length of the packs, pattern
    packs: list[tuple[int, tuple]] = []  # number of packs, pieces as (length, first rank, offset) with a link to the earlier ones
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if heap and heap[0][0] + length <= limit:
                used, k = heapq.heappop(heap)
                count, pieces = packs[k]
                take = min(count, left)
                if take < count:  # the rest of the pattern stays as it is; its ranks follow those taken
                    packs.append((count - take, (take, pieces)))
                    heapq.heappush(heap, (used, len(packs) - 1))
            else:
                each = min(limit // length, left)  # a new pattern holds as many of this length as fit
                take = left // each
                used, k, pieces = (each - 1) * length, len(packs), None
                for n in range(each - 1):
                    pieces = (0, pieces, length, rank + n * take, n * length)
                rank, left = rank + (each - 1) * take, left - (each - 1) * take
                packs.append((take, None))
            packs[k] = (take, (0, pieces, length, rank, used))
            if used + length < limit:
                heapq.heappush(heap, (used + length, k))
            rank, left = rank + take, left - take
    placed: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for count, node in packs:
        shift = 0
        while node is not None:
            if len(node) == 2:
                shift, node = shift + node[0], node[1]
            else:
                _, earlier, length, rank, offset = node
                placed.setdefault(length, []).append((rank + shift, count, base, offset))
                node = earlier
        base += count
    return {length: np.array(sorted(x), np.int64) for length, x in placed.items()}, base


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, limit: int) -> DataFrame:
    """Whole texts to ids, cut into pieces of `limit` ids and a rest: PIECE_SCHEMA, without the ids."""
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                coded = enc.encode(part.column("text").to_pylist(), end_id)
                counts = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
                pieces = -(-counts // limit)
                row = np.repeat(np.arange(len(counts)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * limit
                length = np.minimum(limit, counts[row] - start)
                crc = [zlib.crc32(memoryview(coded[k])[4 * a : 4 * (a + limit)]) for k, a in zip(row.tolist(), start.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(counts[row])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECE_SCHEMA)


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, limit: int = LIMIT) -> DataFrame:
    """Packs all documents into sequences of at most `limit` ids.

    The driver sees the histogram of piece lengths only (at most `limit` rows). A piece's rank among
    those of its length is its global row number, in the order (length, hash of doc_id, doc_id,
    start), less the number of shorter pieces, so no length, however common, is gathered in a task.
    Defined results: null or empty text is the end id alone; null doc_ids and repeated rows are
    packed like others; an empty table gives an empty result; other columns are ignored.
    """
    pieces = settle(cut_documents(docs, tokenizer, end_id, limit)).withColumn("__deal", F.xxhash64("doc_id", "start"))  # dealing by range reads its input twice
    numbered, _ = number_rows(pieces, ["length", "__deal", "doc_id", "start", "ids_crc32"])
    histogram = {int(r["length"]): int(r["n"]) for r in numbered.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed, _ = pack_histogram(histogram, limit)
    below = np.zeros(limit + 2, np.int64)
    for length, n in histogram.items():
        below[length + 1] += n
    shared = docs.sparkSession.sparkContext.broadcast((placed, np.cumsum(below)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, before = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("row_number").to_numpy() - before[length]
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for own in np.unique(length).tolist():
                rows = np.flatnonzero(length == own)
                table = entries[own]
                k = np.searchsorted(table[:, 0], rank[rows], "right") - 1
                sequence[rows] = table[k, 2] + rank[rows] - table[k, 0]
                offset[rows] = table[k, 3]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return numbered.drop("__deal").mapInArrow(place, PACKED_SCHEMA)
