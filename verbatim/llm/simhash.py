"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by BK-trees of shards."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bktree import forest_links
from .common import partitions, settle, slices, small_batches
from .components import components

SEED = 42
BITS = 64
#: Fingerprints of a shard above which it is dealt anew by the bits it does not yet share.
SHARD_MOST = 2048
#: Rows of one fingerprint above which its component reaches them by broadcast instead of a shuffle.
HOT_ROWS = 1 << 16
_CHUNK = 1 << 16


def fingerprint(raw: bytes | None, shingle: int = 3) -> int:
    """Of UTF-8 text: A-Z lower-cased, words between ASCII white space, shingles with repeats.

    A bit is 1 if more than half of the shingles' XXH64 (seed 42) have it; no words give 0.
    """
    words = (raw or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    parts = map(partial(xxhash.xxh64_intdigest, seed=SEED), map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle)), strict=False)))
    n, counts = len(words) - shingle + 1, np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        counts += _ballot(np.fromiter(parts, np.uint64, min(_CHUNK, n - at)))
    return _majority(counts, n)


def _ballot(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)


def _majority(counts: np.ndarray, n: int) -> int:
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def vote(hashes: np.ndarray) -> int:
    """The fingerprint of hashed shingles."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        counts += _ballot(hashes[at : at + _CHUNK])
    return _majority(counts, len(hashes))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of every row."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "raw"):
                fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in part.column("raw")), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw"))
    return raw.mapInArrow(work, "doc_id long, fp long")


def _blocks(bits: int, parts: int, at: int = 0) -> list[tuple[int, int]]:
    """(shift, width) of so many blocks of about equal width."""
    cuts = [at + round(k * bits / parts) for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(shift: int, width: int) -> int:
    m = ((1 << width) - 1) << shift
    return m - (1 << 64) if m >> 63 else m


def shards(classes: DataFrame, radius: int, most: int = SHARD_MOST) -> DataFrame:
    """Puts every fingerprint into radius + 1 shards, by the value of each of as many blocks of bits.

    Two fingerprints within the radius agree in one block at least, so every link lies inside a
    shard. A shard of more than `most` is dealt anew, with its block's value kept, by blocks of the
    bits outside that block, which again agree in one at least; twice at most.
    """
    parts = radius + 1
    first = _blocks(BITS, parts)
    put = [F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(F.lit(_mask(*b))).alias("value")) for k, b in enumerate(first)]
    level = classes.select("fp", "rep", F.explode(F.array(*put)).alias("s")).select("fp", "rep", F.col("s.block").cast("long").alias("block"), "s.value", F.lit(0).alias("level"))
    out = None
    for depth in (1, 2):
        counts = level.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n"))
        large = counts.where(F.col("n") > most).drop("n")
        if large.isEmpty():
            break
        kept = level.join(large, ["block", "value"], "left_anti")
        out = kept if out is None else out.unionByName(kept)
        again = level.join(large, ["block", "value"])
        rest = []  # for each block (path), the masks of blocks of the bits that it leaves
        paths = range(parts**depth)
        for path in paths:
            masks = _split(path, parts, depth)
            rest.append(F.when(F.col("block") == path, F.array(*[F.struct(F.lit(path * parts + k).cast("long").alias("block"), F.col("value").bitwiseOR(F.col("fp").bitwiseAND(F.lit(m))).alias("value")) for k, m in enumerate(masks)])))
        level = settle(again.select("fp", "rep", F.explode(F.coalesce(*rest)).alias("s")).select("fp", "rep", "s.block", "s.value", F.lit(depth).alias("level")))
    return level if out is None else out.unionByName(level)


def _split(path: int, parts: int, depth: int) -> list[int]:
    """Masks of the blocks into which the bits outside a path's blocks are cut."""
    free = list(range(BITS))
    for d in range(depth):
        k = path // parts ** (depth - 1 - d) % parts
        free = [b for i, b in enumerate(free) if i * parts // len(free) != k]
    out = [sum(1 << b for i, b in enumerate(free) if i * parts // len(free) == k) for k in range(parts)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def links(classes: DataFrame, radius: int = 3, most: int = SHARD_MOST) -> DataFrame:
    """Links (a, b) between representatives, enough to join all that chains of links connect.

    The shards' trees are built where their fingerprints are dealt to; nothing that grows with the
    corpus is broadcast.
    """
    dealt = shards(classes, radius, most)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps, reps = None, [], []
        a: list[int] = []
        b: list[int] = []

        def close() -> None:
            if len(fps) > 1:
                for i, j in forest_links(fps, radius):
                    a.append(reps[i])
                    b.append(reps[j])

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("level", "block", "value", "fp", "rep")), strict=True)
            for level, block, value, fp, rep in rows:
                if (level, block, value) != key:
                    close()
                    key, fps, reps = (level, block, value), [], []
                fps.append(fp & 0xFFFFFFFFFFFFFFFF)
                reps.append(rep)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    n = partitions(classes.sparkSession)
    ordered = dealt.repartition(n, "level", "block", "value").sortWithinPartitions("level", "block", "value", "fp")
    return ordered.mapInArrow(search, "a long, b long")


def named_rows(fps: DataFrame, named: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """Every row of `fps` with the component_id that `named` (fp, component_id, n rows) has for its fp.

    The rows of a fingerprint with more than `hot` rows stay where they are: there are at most
    rows / hot of these, so they are broadcast. The rest meets by shuffle, `hot` rows a key at most.
    """
    large = named.where(F.col("n") > hot).select("fp", "component_id")
    rest = named.where(F.col("n") <= hot).select("fp", "component_id")
    if large.isEmpty():
        return fps.join(rest, "fp")
    still = fps.join(F.broadcast(large), "fp")
    moved = fps.join(F.broadcast(large.select("fp")), "fp", "left_anti").join(rest, "fp")
    return still.unionByName(moved)


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable.

    Rows of one fingerprint form a class that its smallest doc_id stands for; classes within
    `radius` bits are linked. Defined results: null or blank text has fingerprint 0, linked like any
    other; a row without a doc_id never stands for a class, and gets its class's component (null if
    the class has no doc_id); repeated rows get the same result each; an empty table gives an empty
    result; other columns are ignored.
    """
    fps = settle(fingerprints(docs, shingle))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    roots = components(links(classes.where(F.col("rep").isNotNull()), radius))
    named = settle(classes.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id"), "n"))
    out = named_rows(fps, named)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
