"""Suffix-array dedup: bytes of strings that an earlier document has too, by a distributed merge sort of suffixes.

Only suffixes at anchors are sorted: any two equal strings of LENGTH bytes hold an anchor at the same
place (anchors.py), so every repeat shows as two suffixes with a long common prefix, together with
what stands before them. A first exchange of hashes alone finds the anchors that more than one
document has; the suffixes of those are sorted, front-coded and exchanged, and merged by loser trees
(losertree.py). Nothing is decided by hashes: they only say which suffixes need not be looked at.
Parts are many enough that each holds about a block's share, whatever the size of the input. The suffixes
of all parts may take several times the input where much is repeated, so parts are worked on in passes,
as many as keep the suffixes under way below the stored texts; what a pass exchanged is dropped before the
next. An anchor that comes very often, such as a licence's line, stands in ever new surroundings: a
further exchange of hashes finds the strings around it that another place has too, and only those are sent.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import LENGTH, PLACES, SEED_BYTES, anchors, hashes_at
from .common import partitions, release, settle, slices, small_batches, work_path
from .losertree import Run, merge

BEFORE = PLACES - 1
#: Bytes of text in a block, the unit that is stored, sorted and answered.
BLOCK_BYTES = 8 << 20
#: Bytes of text whose suffixes meet in one part, at most.
PART_BYTES = 8 << 20
#: Bytes that a suffix takes in an exchange, about, and what those of one pass may take, as a share of the stored blocks.
SUFFIX_BYTES = 42
PASS_SHARE = 2.0
BLOCK_SCHEMA = "block_id long, doc_ids binary, nulls binary, sizes binary, raw binary, gaps binary, rest binary"
BLOCK_COLUMNS = ("doc_ids", "nulls", "sizes", "raw", "gaps")
RUN_SCHEMA = "part int, block_id long, lcps binary, sizes binary, tails binary, left_sizes binary, lefts binary, docs binary, places binary"
ANSWER_SCHEMA = "block_id long, starts binary, sizes binary"
KEYS_SCHEMA = "block_id long, part int, again long, keys binary, hot binary"
#: An anchor that comes as often as HOT_EACH times in each of HOT_BLOCKS blocks is hot: only those strings around it
#: are sent that another place has too.
HOT_BLOCKS = 256
HOT_EACH = 64
DIGEST_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], [n for n, _ in names])


def _as(kind: str, x) -> bytes:
    return np.asarray(x).astype(kind).tobytes()


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _gaps(raw: bytes) -> bytes:
    """The steps from anchor to anchor, each at most PLACES, so that later steps need not look for them."""
    return _as("u1", np.diff(anchors(np.frombuffer(raw, np.uint8))[0], prepend=0))


def write_blocks(docs: DataFrame, keep: bool) -> DataFrame:
    """Rows packed into blocks, in a table bucketed by block, so that joins on blocks move no text.

    `rest` holds the other columns of the rows if `keep`. Written without a shuffle: a task packs what it reads.
    """
    spark = docs.sparkSession
    small_batches(spark)
    others = [c for c in docs.columns if c != "text"] if keep else []
    frame = docs.select(F.col("doc_id").cast("long").alias("__doc"), F.col("text").cast("string").cast("binary").alias("__raw"), *[F.col(f"`{c}`") for c in others])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            nonlocal n, held, size
            table = pa.Table.from_batches(held)
            ids, raw = table.column("__doc"), [x or b"" for x in table.column("__raw").to_pylist()]
            rest = _stream(table.select(others)) if others else b""
            n, held, size = n + 1, [], 0
            return _batch(BLOCK_SCHEMA, [[(task << 32) + n], [_as("<i8", ids.fill_null(0))], [_as("u1", ids.is_null())], [_as("<i8", [len(x) for x in raw])], [whole := b"".join(raw)], [_gaps(whole)], [rest]])

        for batch in batches:
            for part in slices(batch, "__raw", BLOCK_BYTES):
                own = sum(len(x.as_buffer()) for x in part.column("__raw") if x.is_valid)
                if held and size + own > BLOCK_BYTES:
                    yield block()
                held.append(part)
                size += own
        if held:
            yield block()

    name = f"verbatim_blocks_{uuid.uuid4().hex}"
    writer = frame.mapInArrow(pack, BLOCK_SCHEMA).write.option("compression", "zstd").option("path", work_path(spark, "blocks"))
    writer.bucketBy(partitions(spark), "block_id").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files stay where they were written
    return table


class Block:
    """A stored block: its bytes, documents, and anchors inside documents that have a doc_id."""

    def __init__(self, doc_ids: bytes, nulls: bytes, sizes: bytes, raw: bytes, gaps: bytes):
        self.raw, self.gaps = raw, gaps
        self.doc_ids, self.nulls = np.frombuffer(doc_ids, "<i8"), np.frombuffer(nulls, "u1") > 0
        self.sizes = np.frombuffer(sizes, "<i8")
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes

    def anchors(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, documents (by place in the block) and keys: part << 32 | 32 bits of the hash."""
        at = np.cumsum(np.frombuffer(self.gaps, "u1"), dtype=np.int64)
        doc = np.searchsorted(self.ends, at, "right")
        fits = (at + SEED_BYTES <= self.ends[doc]) & ~self.nulls[doc] & (self.sizes[doc] >= LENGTH) if len(at) else np.zeros(0, bool)
        at, doc = at[fits], doc[fits]
        return at, doc, _dealt(hashes_at(self.raw, at), parts)


def _dealt(h: np.ndarray, parts: int) -> np.ndarray:
    """Keys of hashes: part << 32 | 32 other bits."""
    return ((h & np.uint64(0xFFFFFFFF)) % np.uint64(parts)) << np.uint64(32) | h >> np.uint64(32)


def _row_blocks(batch: pa.RecordBatch):
    for row in zip(*(batch.column(c) for c in BLOCK_COLUMNS), strict=True):
        yield Block(*(bytes(x.as_buffer()) for x in row))


def shared_keys(blocks: DataFrame, parts: int, keys_of: Callable) -> DataFrame:
    """(block_id, shared): each block's keys that another block has too, as lists by part.

    `keys_of(block, shared)` gives a block's keys. For anchors, keys that come very often are listed as hot too,
    and `again` counts how often a key comes once more in the block; not so where `blocks` has `shared` already.
    """
    most, given = HOT_BLOCKS * HOT_EACH, "shared" in blocks.columns

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("shared").to_pylist() if given else [None] * batch.num_rows
            for block_id, block, shared in zip(batch.column("block_id").to_pylist(), _row_blocks(batch), known, strict=True):
                every = np.sort(keys_of(block, shared))
                first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
                keys = every[first]
                own = (keys >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(own, prepend=-1))
                low = keys.astype("<u4")  # the lower half
                ends = np.append(cuts[1:], len(low))[: len(cuts)]
                rows = [low[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]
                times = np.diff(np.append(first, len(every)))
                again = [0 if given else int(times[a:b].sum()) - int(b - a) for a, b in zip(cuts, ends, strict=True)]
                often = [b"" if given else _as("<u2", np.minimum(times[a:b], 65535)) for a, b in zip(cuts, ends, strict=True)]
                yield _batch("part int, block_id long, again long, keys binary, often binary", [own[cuts], [block_id] * len(rows), again, rows, often])

    def meet(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        lists = [np.frombuffer(x.as_buffer(), "<u4") for x in table.column("keys")]
        seen, counts = np.unique(np.concatenate(lists), return_counts=True)
        many = seen[counts > 1]
        met = [np.isin(x, many, assume_unique=True) for x in lists]
        out = [x[m] for x, m in zip(lists, met, strict=True)]
        hot = many[:0]
        if not given:
            often = np.concatenate([np.frombuffer(x.as_buffer(), "<u2")[m] for x, m in zip(table.column("often"), met, strict=True)]).astype(np.int64)
            if often.sum() >= most:
                hot = many[np.bincount(np.searchsorted(many, np.concatenate(out)), often, len(many)) >= most]
        again = table.column("again").to_pylist()
        full = [k for k, x in enumerate(out) if len(x) or again[k]]
        ids = table.column("block_id").to_pylist()
        hots = [out[k][np.isin(out[k], hot, assume_unique=True)].tobytes() if len(hot) else b"" for k in full]
        return pa.table({"block_id": pa.array([ids[k] for k in full], pa.int64()), "part": pa.array([part] * len(full), pa.int32()), "again": pa.array([again[k] for k in full], pa.int64()), "keys": pa.array([out[k].tobytes() for k in full], pa.binary()), "hot": pa.array(hots, pa.binary())})

    sent = blocks.select("block_id", *BLOCK_COLUMNS, *(["shared"] if given else [])).mapInArrow(send, "part int, block_id long, again long, keys binary, often binary")
    met = sent.repartition(_tasks(blocks.sparkSession, parts), "part").groupBy("part").applyInArrow(meet, KEYS_SCHEMA)
    return met.groupBy("block_id").agg(F.collect_list(F.struct("part", "again", "keys", "hot")).alias("shared"))


def _tasks(spark, parts: int) -> int:
    """Tasks for so many parts: a few each, however many the data make."""
    return max(partitions(spark), parts // 4)


def _keys(shared, name: str) -> np.ndarray:
    """The keys of a block's lists, sorted."""
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x[name], "<u4").astype(np.uint64) | np.uint64(x["part"] << 32) for x in shared or [])]))


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known) or not len(keys):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _chosen(block: Block, shared, parts: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of parts from `low` to before `high` that another block or another document of the block has too, and which are hot."""
    at, doc, key = block.anchors(parts)
    own = (key >= np.uint64(low << 32)) & (key < np.uint64(high << 32))
    at, doc, key = at[own], doc[own], key[own]
    order = np.lexsort((doc, key))
    at, doc, key = at[order], doc[order], key[order]
    if not len(key):
        return at, doc, key.astype(np.int64), np.zeros(0, bool)
    start = np.append(True, key[1:] != key[:-1])
    fresh = np.flatnonzero(start)
    last = np.append(fresh[1:], len(key)) - 1
    several = (doc[fresh] != doc[last]) | _among(key[fresh], _keys(shared, "keys"))
    hot = _among(key[fresh], _keys(shared, "hot"))
    group = np.cumsum(start) - 1
    take = several[group]
    return at[take], doc[take], (key[take] >> np.uint64(32)).astype(np.int64), hot[group][take]


def _around(block: Block, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the first and the last string of LENGTH bytes around an anchor begin; the last lies before the first if there is none."""
    return np.maximum(block.starts[doc], at - BEFORE), np.minimum(at, block.ends[doc] - LENGTH)


def _strings(block: Block, low: np.ndarray, high: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The places from `low` to `high`, each once, and the keys of the strings of LENGTH bytes there."""
    step = np.zeros(len(block.raw) + 1, np.int32)
    fits = low <= high
    np.add.at(step, low[fits], 1)
    np.add.at(step, high[fits] + 1, -1)
    starts = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    h = hashes_at(block.raw, starts) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(31)) + hashes_at(block.raw, starts + SEED_BYTES)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(29)) + hashes_at(block.raw, starts + LENGTH - SEED_BYTES)
    h = h * np.uint64(0x94D049BB133111EB)
    return starts, _dealt(h ^ h >> np.uint64(32), parts)


def _trimmed(block: Block, at: np.ndarray, doc: np.ndarray, common, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of a string around each anchor that another place has too, as far as hashes tell."""
    low, high = _around(block, at, doc)
    starts, keys = _strings(block, low, high, parts)
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    kept = starts[(counts[back] > 1) | _among(keys, _keys(common, "keys"))]
    if not len(kept):
        return low, low - 1
    first, last = np.searchsorted(kept, low), np.searchsorted(kept, high, "right") - 1
    found = (low <= high) & (first <= last)
    return np.where(found, kept[np.minimum(first, len(kept) - 1)], low), np.where(found, kept[last], low - 1)


def _runs(block_id: int, block: Block, shared, common, parts: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Front-coded sorted runs of the chosen suffixes by part; what the block can answer itself goes as an answer."""
    at, doc, part, hot = _chosen(block, shared, parts, low, high)
    raw = block.raw
    begin = np.maximum(block.starts[doc], at - BEFORE)
    end = np.minimum(block.ends[doc], at + LENGTH)
    if hot.any():
        first, last = _trimmed(block, at[hot], doc[hot], common, high - low)
        begin[hot], end[hot] = first, last + LENGTH
    wide = end - begin >= LENGTH
    same: dict[tuple, list[int]] = {}
    places, begins, ends, parted = at[wide].tolist(), begin[wide].tolist(), end[wide].tolist(), part[wide].tolist()
    ids = block.doc_ids[doc[wide]].tolist()
    for k, (p, a, b, q) in enumerate(zip(places, begins, ends, parted, strict=True)):
        same.setdefault((q, raw[p:b], raw[a:p]), []).append(k)
    covered: list[int] = []
    entries: list[tuple] = []
    for (q, right, left), own in same.items():
        first = min(ids[k] for k in own)
        for k in own:
            if ids[k] > first:
                covered.append(k)
            else:
                entries.append((q, right, left, first, places[k]))
    if covered:
        starts, stops = np.array([begins[k] for k in covered]), np.array([ends[k] for k in covered])
        yield _batch(RUN_SCHEMA, [[int(block_id % parts)], [block_id], [b""], [b""], [b""], [b""], [b""], [_as("<u4", starts)], [_as("u1", stops - starts)]])
    entries.sort()
    by_part = np.array([e[0] for e in entries], np.int64)
    cuts = np.flatnonzero(np.diff(by_part, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(entries)], strict=False):  # nothing if there are no entries
        own = entries[a:b]
        rights = [e[1] for e in own]
        size = np.fromiter(map(len, rights), np.int64, len(own))
        table = np.frombuffer(b"".join(r.ljust(LENGTH, b"\0") for r in rights), np.uint8).reshape(-1, LENGTH)
        differ = np.ones((len(own), LENGTH + 1), bool)
        differ[1:, :LENGTH] = table[1:] != table[:-1]
        lcps = np.minimum(differ.argmax(1), size)
        lcps[1:] = np.minimum(lcps[1:], size[:-1])
        lcps[0] = 0
        tails = [r[n:] for r, n in zip(rights, lcps.tolist(), strict=True)]
        lefts = [e[2] for e in own]
        yield _batch(RUN_SCHEMA, [[own[0][0]], [block_id], [_as("u1", lcps)], [_as("u1", [len(t) for t in tails])], [b"".join(tails)], [_as("u1", [len(x) for x in lefts])], [b"".join(lefts)], [_as("<i8", [e[3] for e in own])], [_as("<u4", [e[4] for e in own])]])


class Answers:
    """Byte ranges by block, none longer than BEFORE + LENGTH."""

    def __init__(self):
        self.found: dict[int, tuple[list[int], list[int]]] = {}

    def put(self, block_id: int, start: int, end: int) -> None:
        starts, ends = self.found.setdefault(block_id, ([], []))
        starts.append(start)
        ends.append(end)

    def table(self, raw_rows: list[tuple[int, bytes, bytes]]) -> pa.Table:
        rows = list(raw_rows)
        for block_id, (starts, ends) in self.found.items():
            at, size = np.array(starts), np.array(ends) - np.array(starts)
            order = np.argsort(at)
            rows.append((block_id, _as("<u4", at[order]), _as("u1", size[order])))
        return pa.table({"block_id": pa.array([r[0] for r in rows], pa.int64()), "starts": pa.array([r[1] for r in rows], pa.binary()), "sizes": pa.array([r[2] for r in rows], pa.binary())})


def _settle_group(group: list[tuple], answers: Answers) -> None:
    """Suffixes that share an anchor, as (right, left, doc_id, block, place): which of their strings a smaller doc_id has.

    One string of LENGTH bytes for each place of the anchor in it; the smallest doc_id of each is kept
    in a table, so the work grows with the suffixes, not with their pairs.
    """
    least: dict[tuple[bytes, bytes], int] = {}
    for right, left, doc, _, _ in group:
        key = (right, left)
        if doc < least.get(key, doc + 1):
            least[key] = doc
    windows: dict[tuple[bytes, bytes], tuple[int, list[bytes]]] = {}
    first: dict[bytes, int] = {}
    if len(least) > 1:
        for (right, left), doc in least.items():
            low, high = max(0, LENGTH - len(right)), min(BEFORE, len(left))
            both = left + right
            own = [both[len(left) - o : len(left) - o + LENGTH] for o in range(low, high + 1)]
            windows[right, left] = (low, own)
            for w in own:
                if w not in first or doc < first[w]:
                    first[w] = doc
    for right, left, doc, block_id, place in group:
        if least[right, left] < doc:
            answers.put(block_id, place - len(left), place + len(right))
        elif windows:
            low, own = windows[right, left]
            hits = [o for o, w in enumerate(own, low) if first[w] < doc]
            if hits:
                answers.put(block_id, place - hits[-1], place - hits[0] + LENGTH)


def _merge_part(table: pa.Table) -> pa.Table:
    runs, passed, answers = [], [], Answers()
    for row in table.to_batches():
        for block_id, lcps, sizes, tails, left_sizes, lefts, docs, places in zip(*(row.column(c).to_pylist() for c in ("block_id", "lcps", "sizes", "tails", "left_sizes", "lefts", "docs", "places")), strict=True):
            if not lcps:
                passed.append((block_id, docs, places))
                continue
            ends = np.cumsum(np.frombuffer(sizes, "u1").astype(np.int64)).tolist()
            left_ends = np.cumsum(np.frombuffer(left_sizes, "u1").astype(np.int64)).tolist()
            runs.append(Run(lcps, ends, tails, (block_id, lefts, left_ends, np.frombuffer(docs, "<i8").tolist(), np.frombuffer(places, "<u4").tolist())))
    group: list[tuple] = []
    for known, text, run in merge(runs) if runs else ():
        if known < SEED_BYTES:
            if len(group) > 1:
                _settle_group(group, answers)
            group = []
        block_id, lefts, left_ends, docs, places = run.payload
        k = run.at
        group.append((text, lefts[left_ends[k - 1] if k else 0 : left_ends[k]], docs[k], block_id, places[k]))
    if len(group) > 1:
        _settle_group(group, answers)
    return answers.table(passed)


def _stored(df: DataFrame, path: str) -> DataFrame:
    """Written to a path in the shared folder, compressed, and read from there."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drop(spark, path: str) -> None:
    """Deletes what was stored there for one step alone."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _passes(blocks: DataFrame, shared: DataFrame) -> int:
    """Passes over the parts: what the suffixes of one take stays below PASS_SHARE of the stored blocks."""
    stored = blocks.select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.sum("file_size")).first()[0] or 0
    suffixes = shared.selectExpr("sum(aggregate(shared, 0L, (n, x) -> n + x.again + length(x.keys) div 4))").first()[0] or 0
    return max(1, -(-suffixes * SUFFIX_BYTES // max(1, int(stored * PASS_SHARE))))


def _pass(blocks: DataFrame, shared: DataFrame, parts: int, low: int, high: int) -> DataFrame:
    """The answers of the parts from `low` to before `high`, stored."""
    spark = blocks.sparkSession
    some = shared.selectExpr("block_id", f"filter(shared, x -> x.part >= {low} AND x.part < {high}) AS shared").where("size(shared) > 0")
    joined = blocks.join(some, "block_id", "left").select("block_id", *BLOCK_COLUMNS, "shared")
    path = None
    if not some.where("exists(shared, x -> length(x.hot) > 0)").isEmpty():

        def strings(block: Block, known) -> np.ndarray:
            at, doc, _, hot = _chosen(block, known, parts, low, high)
            return _strings(block, *_around(block, at[hot], doc[hot]), high - low)[1]

        hot = joined.where("exists(shared, x -> length(x.hot) > 0)")
        path = work_path(spark, "strings")
        common = _stored(shared_keys(hot, high - low, strings).withColumnRenamed("shared", "common"), path)
        joined = joined.join(common, "block_id", "left")
        del hot
        release(spark)

    trims = path is not None

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = batch.column("common").to_pylist() if trims else [None] * batch.num_rows
            for block_id, block, known, more in zip(batch.column("block_id").to_pylist(), _row_blocks(batch), batch.column("shared").to_pylist(), common, strict=True):
                yield from _runs(block_id, block, known, more, parts, low, high)

    runs = joined.mapInArrow(send, RUN_SCHEMA)
    answers = _stored(runs.repartition(_tasks(spark, high - low), "part").groupBy("part").applyInArrow(_merge_part, ANSWER_SCHEMA), work_path(spark, "answers"))
    if path is not None:
        _drop(spark, path)
    return answers


def repeats(docs: DataFrame, keep: bool) -> DataFrame:
    """The stored blocks with the byte ranges to remove: BLOCK_SCHEMA and `found`, a list of (starts, sizes)."""
    spark = docs.sparkSession
    blocks = write_blocks(docs, keep)
    release(spark)
    parts = max(4 * partitions(spark), -(-blocks.count() * BLOCK_BYTES // PART_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a block is some megabytes
    shared = settle(shared_keys(blocks, parts, lambda block, _: block.anchors(parts)[2]))
    release(spark)
    passes, answers = min(parts, _passes(blocks, shared)), []
    for k in range(passes):
        answers.append(_pass(blocks, shared, parts, parts * k // passes, parts * (k + 1) // passes))
        release(spark)
    every = reduce(DataFrame.unionByName, answers)
    found = every.groupBy("block_id").agg(F.collect_list(F.struct("starts", "sizes")).alias("found"))
    return blocks.join(found, "block_id", "left")


def _removed(block: Block, found) -> np.ndarray:
    """A flag for each byte of the block."""
    step = np.zeros(len(block.raw) + 1, np.int32)
    for x in found or []:
        starts = np.frombuffer(x["starts"], "<u4").astype(np.int64)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + np.frombuffer(x["sizes"], "u1"), -1)
    return np.cumsum(step[:-1]) > 0


def _pieces(block: Block, gone: np.ndarray):
    """Per document: bytes, bytes removed, runs removed, and the bytes that are left."""
    raw = np.frombuffer(block.raw, np.uint8)
    for a, b in zip(block.starts.tolist(), block.ends.tolist(), strict=True):
        own = gone[a:b]
        n = int(np.count_nonzero(own))
        spans = int(np.count_nonzero(own[1:] & ~own[:-1])) + int(own[0]) if n else 0
        yield b - a, n, spans, raw[a:b][~own].tobytes() if n else block.raw[a:b]


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256, where every byte covered by a
    LENGTH-byte string that also starts in a document with a smaller doc_id is removed.

    Defined results: null text is empty; a row without a doc_id neither loses bytes nor takes them from
    others; rows of one doc_id do not count as earlier than each other; texts under LENGTH bytes are
    left alone; an empty table gives an empty result; other columns are ignored.
    """
    marked = repeats(docs, keep=False)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, found in zip(_row_blocks(batch), batch.column("found").to_pylist(), strict=True):
                rows = [(n, r, s, hashlib.sha256(kept).hexdigest()) for n, r, s, kept in _pieces(block, _removed(block, found))]
                columns = list(zip(*rows, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, mask=block.nulls), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marked.select(*BLOCK_COLUMNS, "found").mapInArrow(digest, DIGEST_SCHEMA)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with their texts less those bytes; half a character that is left over goes too.

    Null texts become empty; otherwise as repeated_bytes.
    """
    marked = repeats(docs, keep=True)
    columns = docs.columns
    schema = T.StructType([f if f.name != "text" else T.StructField("text", T.StringType()) for f in docs.schema.fields])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, found, rest in zip(_row_blocks(batch), batch.column("found").to_pylist(), batch.column("rest").to_pylist(), strict=True):
                texts = [kept.decode("utf-8", "ignore") for _, _, _, kept in _pieces(block, _removed(block, found))]
                own = {"text": pa.array(texts, pa.string())}
                if rest:
                    others = pa.ipc.open_stream(rest).read_all()
                    own |= {c: others.column(c).combine_chunks() for c in others.column_names}
                yield pa.RecordBatch.from_arrays([own[c] for c in columns], columns)

    return marked.mapInArrow(clean, schema)
