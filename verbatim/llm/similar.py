"""SimHash near-duplicates of a stated similarity: BK-trees of fingerprints in shards, and an exact check of each link.

Blocks of bits, which shard the fingerprints of simhash.py, can't reach texts that share four fifths of
their shingles: these differ in ten bits on average. So texts are dealt to shards by the least hashes of
their shingles, which such texts share, and each shard's tree is asked within a wide radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bktree import BKTree
from .common import partitions, settle, slices, small_batches
from .components import components
from .simhash import SEED, vote

SHINGLE = 5
#: Least similarity of a link, as a fraction, so that no rounding decides.
LEAST = (4, 5)
#: Bits in which fingerprints of a link may differ: at 0.8 the mean is 10 of 64 and more than 28 have probability 1e-8
#: (1e-6 for the worst of sizes, four shingles of which five have all); a fifth of unrelated texts are within it.
RADIUS = 28
#: A pair at exactly 0.8 shares no shard with probability (1 - 0.8**3) ** 24 = 3e-8, more similar ones with less.
BANDS, ROWS = 24, 3
#: Members of a shard above which it is dealt out by pairs of parts, so that each task holds two parts at most.
BUCKET_MOST = 1024
#: Classes to drop or thin that may be broadcast (about 30 bytes each); more are joined by a shuffle.
BROADCAST_CLASSES = 1 << 18
#: The bound's table has so many places for each hash of the largest set, up to so many bits; sets it looks at first,
#: and hashes at a time (one larger set alone).
MARKS, MARK_BITS, FIRST, CHUNK = 32, 24, 16, 1 << 20
_CHUNK = 1 << 13
_RANDOM = np.random.default_rng(SEED)
_XOR = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_ODD = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def shingles(raw: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' XXH64, sorted: A-Z lower-cased, words between ASCII white space.

    Fewer words than `size` make one shingle; so does a text without words, equal to all others without.
    """
    words = (raw or b"").lower().split()
    parts = map(b" ".join, zip(*(islice(words, k, None) for k in range(size)), strict=False)) if len(words) > size else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of ROWS minima; the band's number is hashed with them."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        np.minimum(least, ((hashes[at : at + _CHUNK] ^ _XOR) * _ODD).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.fromiter((xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)), np.uint64, BANDS).view(np.int64)


def similar(x: np.ndarray, y: np.ndarray, least: tuple[int, int] = LEAST) -> bool:
    """Jaccard similarity of two sorted sets is at least `least`."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) * least[1] < len(y) * least[0]:
        return False
    both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return both * least[1] >= (len(x) + len(y) - both) * least[0]


class _Bound:
    """Which sets of a shard may be similar to one of them: an upper bound of what they share, for many at a time.

    The one's hashes are marked in a table by their low bits. A set shares no more hashes with it than
    fall on marks, so what the bound refuses is not similar; the rest is compared exactly.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.fromiter(map(len, sets), np.int64, len(sets))
        most = int(self.sizes.max(initial=1))
        self.table = np.zeros(1 << min(max((MARKS * most - 1).bit_length(), 12), MARK_BITS), bool)
        self.low = np.uint64(len(self.table) - 1)

    def may(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that the bound does not refuse."""
        up, down = LEAST
        size, sizes = int(self.sizes[i]), self.sizes[others]
        fit = np.minimum(sizes, size) * down >= np.maximum(sizes, size) * up
        others, sizes = others[fit], sizes[fit]
        if not len(others):
            return others
        marks = (self.sets[i] & self.low).astype(np.int64)
        self.table[marks] = True
        ends = np.cumsum(sizes)
        hit = self.table[(np.concatenate([self.sets[j] for j in others.tolist()]) & self.low).astype(np.int64)]
        self.table[marks] = False
        both = np.minimum(np.add.reduceat(hit, ends - sizes, dtype=np.int64), np.minimum(sizes, size))
        return others[both * down >= (size + sizes - both) * up]


def tree_links(fps: list[int], sets: list[np.ndarray], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (place, place) that join all texts of a shard that chains of links connect; fewer than texts.

    Fingerprints go into the tree one by one and ask it first; what it finds is compared exactly,
    unless it is in the same group already or the bound refuses it.
    """
    tree, members, place, out = BKTree(), [], {}, []
    group, bound = np.arange(len(fps)), _Bound(sets)
    for i, fp in enumerate(fps):
        found = np.array([j for k in tree.near(fp, radius) for j in members[k]], np.int64)
        step = FIRST
        while len(found):
            # few at first, as the first link often leaves nothing else to ask; never more than CHUNK hashes
            step = max(1, min(step, int(np.searchsorted(np.cumsum(bound.sizes[found[:step]]), CHUNK, "right"))))
            rest, found = bound.may(i, found[:step]), found[step:]
            while len(rest):
                j, rest = int(rest[0]), rest[1:]
                if similar(sets[i], sets[j]):
                    group[group == group[j]] = group[i]
                    out.append((i, j))
                    rest = rest[group[rest] != group[i]]
            found, step = found[group[found] != group[i]], 2 * step
        if fp not in place:
            place[fp] = tree.add(fp)
            members.append([])
        members[place[fp]].append(i)
    return out


def _class_of(docs: DataFrame) -> Column:
    """Rows of equal text (null counts as empty) are one class: the text's MD5."""
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))


def _signatures(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "raw"):
                sets = [shingles(x.as_py()) for x in part.column("raw")]
                keys, fps = [bands(x) for x in sets], np.fromiter(map(vote, sets), np.uint64, len(sets)).view(np.int64)
                flat = pa.array(np.concatenate(keys)) if keys else pa.array([], pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), flat)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("cls"), pa.array(fps), lists], ["doc_id", "cls", "fp", "keys"])

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _class_of(docs).alias("cls"), F.col("text").cast("string").cast("binary").alias("raw"))
    return raw.mapInArrow(work, "doc_id long, cls binary, fp long, keys array<long>")


def _members(classes: DataFrame) -> DataFrame:
    """(key, n, cid, fp) of every shard with two classes at least; of shards with the same members one stays."""
    rows = classes.select("cid", "fp", F.explode("keys").alias("key"), F.xxhash64("cid").alias("h"), F.xxhash64("cid", F.lit(SEED)).alias("g"))
    found = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"), F.min("cid").alias("least"), F.max("cid").alias("most"))
    chosen = found.where("n > 1").groupBy("n", "h", "g", "least", "most").agg(F.min("key").alias("key")).select("key", "n")
    return settle(rows.select("cid", "fp", "key").join(chosen, "key").select("key", "n", "cid", "fp"))


def near_links(docs: DataFrame, classes: DataFrame, most: int = BUCKET_MOST) -> DataFrame:
    """Links (a, b) between classes, each compared exactly, enough to join all that chains of them connect.

    Only classes in a shard with others go on; their shingles go to each such shard once.
    """
    small_batches(docs.sparkSession)
    members = _members(classes)
    wanted = members.select("cid").distinct().join(classes.select("cid", "cls"), "cid")
    texts = docs.select(_class_of(docs).alias("cls"), F.col("text").cast("string").cast("binary").alias("raw")).join(wanted, "cls").dropDuplicates(["cid"]).select("cid", "raw")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "raw"):
                yield pa.RecordBatch.from_arrays([part.column("cid"), pa.array([shingles(x.as_py()).tobytes() for x in part.column("raw")], pa.binary())], ["cid", "hashes"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cids, fps, held = None, [], [], []
        a: list[int] = []
        b: list[int] = []

        def close() -> None:
            if len(cids) > 1:
                for i, j in tree_links(fps, held):
                    a.append(cids[i])
                    b.append(cids[j])

        for batch in batches:
            for *now, cid, fp, hashes in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "cid", "fp", "hashes")), strict=True):
                if now != key:
                    close()
                    key, cids, fps, held = now, [], [], []
                cids.append(cid)
                fps.append(fp & 0xFFFFFFFFFFFFFFFF)
                held.append(np.frombuffer(hashes, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    parts = F.ceil(F.col("n") / most)
    part = F.pmod(F.xxhash64("cid"), parts)
    dealt = members.select("key", "cid", "fp", part.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
    dealt = dealt.select("key", "cid", "fp", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    joined = dealt.join(texts.mapInArrow(sets, "cid long, hashes binary"), "cid")
    ordered = joined.repartition(partitions(docs.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "cid")
    return ordered.select("key", "i", "j", "cid", "fp", "hashes").mapInArrow(search, "a long, b long")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents, all columns; one row stays of all that chains of Jaccard >= 0.8 over five-word shingles connect.

    The smallest doc_id stays, rows without one last. Rows are told apart by (doc_id, text), so rows
    of one doc_id with different texts are judged each by its text. Texts without words are equal.
    """
    per = _signatures(docs).groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    classes = settle(per.withColumn("cid", F.monotonically_increasing_id()))
    roots = settle(components(near_links(docs, classes)))
    linked = roots.join(classes.select("cid", "rep"), F.col("cid") == F.col("node"))
    best = linked.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "cid")).alias("best"))
    # a root has no row of its own among the nodes
    alone = classes.join(roots.select("root").distinct(), F.col("cid") == F.col("root")).select("root", F.struct(F.col("rep").isNull().alias("none"), "rep", "cid").alias("best"))
    best = best.unionByName(alone).groupBy("root").agg(F.min("best").alias("best")).select("root", F.col("best.cid").alias("winner"))
    comp = roots.select("node", "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    lost = comp.join(best, "root").where(F.col("node") != F.col("winner")).select(F.col("node").alias("cid"), F.lit(True).alias("lost"))
    pad = "_" * (1 + max(map(len, docs.columns)))  # longer than any column's name, so no name clashes
    own, cls, rep = f"{pad}own", f"{pad}cls", f"{pad}rep"
    special = settle(classes.select("cid", "cls", "rep", "n").join(lost, "cid", "left").where("lost or n > 1").select(F.col("cls").alias(cls), F.col("rep").alias(rep), F.coalesce("lost", F.lit(False)).alias("lost")))
    put = F.broadcast if special.count() <= BROADCAST_CLASSES else lambda x: x
    keyed = docs.withColumn(own, _class_of(docs))
    rest = keyed.join(put(special.select(cls)), F.col(own) == F.col(cls), "left_anti")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(rep))
    thinned = keyed.join(put(special.where("not lost").select(cls, rep)), (F.col(own) == F.col(cls)) & same).dropDuplicates([cls])
    return rest.select(*docs.columns).unionByName(thinned.select(*docs.columns))
