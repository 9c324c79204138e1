"""Nearest neighbours by multi-index hashing: learned rotated binary codes, substring tables, pigeonhole probing, exact reranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Vectors that rotations and radii are fitted on at most.
SAMPLE_ROWS = 8192
#: Vectors of a shard and their bytes in double precision, whichever is less; queries that meet it in one task.
SHARD_ROWS, SHARD_BYTES = 1 << 17, 64 << 20
QUERY_ROWS, QUERY_LEAST = 1 << 16, 256
#: A code is so many substrings of so many bits, each with a table of its own.
SUBSTRINGS, SUBSTRING_BITS = 28, 16
RESULT = "query_id long, vec_id long, score double"


@dataclass
class Coder:
    """Codes are the signs of centred and rotated vectors, as rows of 16-bit substrings.

    A table is probed for all values within `probe` bits of a query's substring. By the pigeonhole
    principle that finds every code within (probe + 1) * SUBSTRINGS - 1 bits, and of those further away
    the ones that agree so well in some substring; what is found is reranked if it lies within `radius`.
    """

    mean: np.ndarray
    turn: np.ndarray
    norm: float
    probe: int
    radius: int

    def lift(self, x: np.ndarray, base: bool) -> np.ndarray:
        """One more component that makes all rows of the base equally long, so that angles follow inner products."""
        extra = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0)) if base else np.zeros(len(x))
        return np.column_stack([x, extra])

    def codes(self, x: np.ndarray, base: bool, step: int = 1 << 13) -> np.ndarray:
        """SUBSTRINGS numbers of 16 bits for each row. Queries are scaled to the base's length first."""
        out = np.zeros((len(x), SUBSTRINGS), np.uint16)
        for at in range(0, len(x), step):
            part = x[at : at + step].astype(np.float64)
            if not base:
                size = np.sqrt((part * part).sum(1, keepdims=True))
                part = part * (self.norm / np.where(size > 0, size, 1))
            out[at : at + step] = np.packbits((self.lift(part, base) - self.mean) @ self.turn > 0, axis=1).view(np.uint16)
        return out


def fit(sample: np.ndarray, norm: float, k: int = 20, recall: float = 0.93, rounds: int = 30, seed: int = 5) -> Coder:
    """Principal directions, then for each part of the code the rotation that brings them nearest to their signs (alternating, by SVD).

    `radius` holds 99 in 100 of the `k` true neighbours of some sample rows, and `probe` is the least with
    which `recall` of them are found. In a sample of a table as many fewer are asked for, as they stand
    for those of the whole: the nearest of 1 in 10 rows is about as far as the tenth of all.
    """
    coder = Coder(np.zeros(sample.shape[1] + 1), np.zeros((sample.shape[1] + 1, 0)), norm, SUBSTRING_BITS, SUBSTRINGS * SUBSTRING_BITS)
    x = coder.lift(sample, True)
    coder.mean = x.mean(0)
    bits, rng = SUBSTRINGS * SUBSTRING_BITS, np.random.default_rng(seed)
    size, axes = np.linalg.eigh((x - coder.mean).T @ (x - coder.mean))
    axes = axes[:, size > max(size[-1], 1e-300) * 1e-12][:, ::-1]
    if not axes.shape[1]:  # all rows are equal
        axes = np.eye(len(axes))
    v, turns = (x - coder.mean) @ axes, []
    while sum(t.shape[1] for t in turns) < bits:
        turn, _ = np.linalg.qr(rng.normal(size=(axes.shape[1], axes.shape[1])))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.sign(v @ turn).T @ v)
            turn = (u @ w).T
        turns.append(axes @ turn)
    coder.turn = np.column_stack(turns)[:, :bits]
    base, asked = coder.codes(sample, True), min(len(sample), 400)
    pick = rng.choice(len(sample), asked, replace=False)
    far, nearest = [np.zeros(0, int)], [np.zeros(0, int)]
    q = coder.codes(sample[pick], False)
    for i, row in enumerate(pick):
        score = sample @ sample[row]
        score[row] = -np.inf
        near = np.argsort(-score)[: min(k, len(sample) - 1)]
        apart = np.bitwise_count(base[near] ^ q[i]).astype(int)
        far.append(apart.sum(1))
        nearest.append(apart.min(1))
    far, nearest = np.concatenate(far), np.concatenate(nearest)
    if len(far):
        coder.radius = int(np.quantile(far, 0.99, method="higher"))
        coder.probe = next(t for t in range(SUBSTRING_BITS + 1) if ((nearest <= t) & (far <= coder.radius)).mean() >= recall)
    return coder


class Shard:
    """Substring tables of a shard's codes: for each of them and each value, the rows that have it."""

    def __init__(self, coder: Coder, ids: np.ndarray, x: np.ndarray):
        self.coder, self.ids, self.x = coder, ids, x
        self.codes = coder.codes(x, True)
        values = np.arange(1 << SUBSTRING_BITS, dtype=np.uint16)
        self.near = values[np.bitwise_count(values) <= coder.probe]
        self.orders, self.begins = [], []
        for j in range(SUBSTRINGS):
            self.orders.append(np.argsort(self.codes[:, j], kind="stable").astype(np.int32))
            counts = np.bincount(self.codes[:, j], minlength=len(values))
            self.begins.append(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        self.mark = np.zeros(len(ids), bool)

    def probed(self, code: np.ndarray) -> np.ndarray:
        """Rows that have a substring within `probe` bits of the query's: the buckets of all such values."""
        for order, begins, value in zip(self.orders, self.begins, code, strict=True):
            wanted = (self.near ^ value).astype(np.int32)
            first, count = begins[wanted], begins[wanted + 1]
            count -= first
            full = count > 0
            first, count = first[full], count[full]
            if len(first):
                ends = np.cumsum(count)
                self.mark[order[np.repeat(first - (ends - count), count) + np.arange(ends[-1])]] = True
        rows = np.flatnonzero(self.mark)
        self.mark[rows] = False
        return rows

    def within(self, code: np.ndarray) -> np.ndarray:
        """Those of them whose whole code is within the radius."""
        rows = self.probed(code)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1, dtype=np.int32) <= self.coder.radius]

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each query's k best rows here by exact inner product, ties to the smaller id."""
        codes, out = self.coder.codes(q, False), []
        for i in range(len(q)):
            rows = self.within(codes[i])
            rows = rows[self.ids[rows] != query_ids[i]]
            if len(rows) < k:  # too few codes are found: all rows are looked at
                rows = np.flatnonzero(self.ids != query_ids[i])
            score = (self.x[rows].astype(np.float64) * q[i].astype(np.float64)).sum(1)
            if len(rows) > k:
                cut = np.partition(score, len(score) - k)[len(score) - k]
                rows, score = rows[score >= cut], score[score >= cut]
            best = np.lexsort((self.ids[rows], -score))[:k]
            out.append((np.full(len(best), query_ids[i]), self.ids[rows[best]], score[best]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def usable(column: str, dim: int) -> Column:
    """Vectors of the table's dimension, all components finite, not all zero."""
    x = F.transform(column, lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) == dim) & fine & F.exists(x, lambda c: c != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 1)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """For each row whose vec_id is divisible by `every`: its k nearest other rows by inner product.

    All rows are indexed, in shards of about SHARD_ROWS or SHARD_BYTES; every block of queries meets every shard, and
    a shard returns k rows for each query at most. Columns: query_id, rank (from 1), vec_id, score.
    Defined results: null, zero, non-finite vectors and vectors of another than the most common
    dimension take no part, nor do rows without a vec_id; a vec_id that occurs twice is asked once, with
    the smaller of its vectors, and is a candidate twice, but never for itself; equal scores go by
    vec_id; with fewer candidates than k all are returned; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull())
    dims = own.where(F.col("embedding").isNotNull()).groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    row = dims.orderBy(F.col("n").desc(), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if row is None or not row["d"]:
        return empty
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"  # kept as it is; all else becomes double
    good = own.where(usable("embedding", row["d"])).select("vec_id", F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    figures = good.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(square)).alias("norm"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q")).first()
    n = figures["n"]
    if not n:
        return empty
    cut = 1 << 30 if n <= SAMPLE_ROWS else int((1 << 30) * SAMPLE_ROWS * 1.05 / n) + 1
    key = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    sample = good.where(key < cut).orderBy(key, "vec_id").limit(SAMPLE_ROWS).select("embedding").toArrow()
    rows = _matrix(sample.column("embedding")).astype(np.float64)
    coder = spark.sparkContext.broadcast(fit(rows, figures["norm"], max(1, round(k * len(rows) / n))))
    fit_rows = max(1, SHARD_BYTES // (8 * row["d"]))
    shards, asks, most = -(-n // min(SHARD_ROWS, fit_rows)), int(figures["q"]), min(QUERY_ROWS, fit_rows)
    # with few shards the queries are dealt to as many tasks as there are cores
    blocks = max(-(-asks // most), min(-(-spark.sparkContext.defaultParallelism // shards), -(-asks // QUERY_LEAST)), 1)
    base = good.select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "embedding")
    asked = good.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int").alias("block"), "vec_id", "embedding")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        empty_result = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty_result
        shard = Shard(coder.value, left.column("vec_id").to_numpy(), _matrix(left.column("embedding")))
        found = shard.search(right.column("vec_id").to_numpy(), _matrix(right.column("embedding")), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    found = base.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(meet, RESULT)
    ranked = found.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def recall(found: DataFrame, vectors: DataFrame, k: int = 20) -> float:
    """Share of the true k nearest that were found, by brute force on the driver; for tests."""
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect() if r["embedding"] is not None]
    ids, x = np.array([i for i, _ in rows]), np.array([e for _, e in rows], float)
    got: dict[int, set[int]] = {}
    for r in found.collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = total = 0
    for q in got:
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        true = set(ids[np.lexsort((ids, -score))[: min(k, len(ids) - 1)]].tolist())
        hit, total = hit + len(true & got[q]), total + len(true)
    return hit / total if total else 1.0


__all__ = ["Coder", "Shard", "fit", "nearest", "recall", "usable"]
