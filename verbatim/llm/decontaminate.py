"""Benchmark decontamination: Wu-Manber search for every window of the items' words in whole documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, slices, small_batches
from .wumanber import WuManber

WINDOW = 13
#: Bytes of item texts whose windows a task holds; more items are searched in groups, one after the other.
ITEMS_BYTES = 16 << 20
#: Bytes that belong to words (digits, letters, all above ASCII), A-Z lower-cased; others separate.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
HITS = {"row": pa.int64(), "doc_id": pa.int64(), "n_words": pa.int64(), "begins": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "items": pa.list_(pa.string())}
RESULT = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_()}
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(WORD_BYTES).split()


def windows_of(items: list[tuple[str, bytes]], window: int = WINDOW) -> list[WuManber]:
    """One searcher for each length of window; owners are places in `items`."""
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    for k, (_, raw) in enumerate(items):
        words = words_of(raw)
        length = min(window, len(words))
        for at in range(len(words) - length + 1) if length else ():
            owners = by_length.setdefault(length, {}).setdefault(tuple(words[at : at + length]), [])
            if not owners or owners[-1] != k:
                owners.append(k)
    return [WuManber(patterns, length) for length, patterns in sorted(by_length.items())]


def _item_groups(benchmark: DataFrame) -> tuple[int, Iterator[list[tuple[str, bytes]]]]:
    """How many groups of bounded size the items make, and the groups as (id, bytes), one at a time on the driver."""
    own = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").cast("binary").alias("raw"))
    total = own.agg(F.coalesce(F.sum(F.length("raw")), F.lit(0))).first()[0]
    groups = int(total // ITEMS_BYTES) + 1

    def each() -> Iterator[list[tuple[str, bytes]]]:
        for k in range(groups):
            part = own if groups == 1 else own.where(F.pmod(F.xxhash64("item_id", "raw"), F.lit(groups)) == k)
            yield [(r["item_id"], bytes(r["raw"])) for r in part.orderBy("item_id").collect()]

    return groups, each()


def _search(docs: DataFrame, items: Broadcast, window: int, every: bool) -> DataFrame:
    """Per row of docs (row, doc_id, raw): the number of words, ranges of hit words and ids of the items that occur.

    The searcher is built once a task. Only rows with hits are given, unless `every`.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers, names = windows_of(items.value, window), items.value
        for batch in batches:
            for part in slices(batch, "raw"):
                rows = []
                for row, doc, raw in zip(part.column("row").to_pylist(), part.column("doc_id").to_pylist(), part.column("raw"), strict=True):
                    words, begins, ends, owners = words_of(raw.as_py()), [], [], set()
                    for s in searchers:
                        for at, own in s.search(words):
                            begins.append(at)
                            ends.append(at + s.length)
                            owners.update(names[o][0] for o in own)
                    if every or begins:
                        rows.append((row, doc, len(words), begins, ends, sorted(owners)))
                columns = list(zip(*rows, strict=True)) or [[]] * len(HITS)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, HITS.values(), strict=True)], list(HITS))

    return docs.mapInArrow(work, "row long, doc_id long, n_words long, begins array<long>, ends array<long>, items array<string>")


def _digest(found: DataFrame, share: int) -> DataFrame:
    """Rows with lists of ranges and items, one for each group of items, to the result's columns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, begins, ends, items in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_words", "begins", "ends", "items")), strict=True):
                step = np.zeros(n + 1, np.int64)
                for b, e in zip(begins, ends, strict=True):  # one pair of lists for each group of items
                    np.add.at(step, np.asarray(b, np.int64), 1)
                    np.add.at(step, np.asarray(e, np.int64), -1)
                hit = int(np.count_nonzero(np.cumsum(step[:-1])))
                names = {x for own in items for x in own}
                rows.append((doc, n, hit, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), hit > 0 and share * hit >= n))
            columns = list(zip(*rows, strict=True)) or [[]] * len(RESULT)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, RESULT.values(), strict=True)], list(RESULT))

    return found.mapInArrow(work, SCHEMA)


def _over_groups(docs: DataFrame, groups: Iterator[list[tuple[str, bytes]]], window: int) -> DataFrame:
    """_search for groups of items in turn, over rows that are stored already; each group's hits are stored, then its items let go."""
    context, found = docs.sparkSession.sparkContext, None
    for k, items in enumerate(groups):
        shared = context.broadcast(items)
        own = settle(_search(docs, shared, window, every=k == 0))
        found = own if found is None else found.unionByName(own)
        shared.unpersist()
    lists = [F.collect_list(c).alias(c) for c in ("begins", "ends", "items")]  # one of each for a group of items
    return found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *lists)


def _with_rows(docs: DataFrame, *columns: Column) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw"), *columns)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """Per document: n_words, n_hit (words inside an occurrence of any window), the items that occur, contaminated.

    Contaminated: any hit, and share * n_hit >= n_words. Items of up to ITEMS_BYTES, measured first, are
    broadcast, and documents are neither shuffled nor cut. More items are searched in groups of that
    size: the texts are stored once, each group is a pass of its own, and only hits meet by row. Defined
    results: null text has no words; an item without words matches nothing, items without an id or text
    are ignored; repeated rows get the same result each; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    n, groups = _item_groups(benchmark)
    if n > 1:
        return _digest(_over_groups(settle(_with_rows(docs)), groups, window), share)
    shared = docs.sparkSession.sparkContext.broadcast(next(groups))
    found = _search(_with_rows(docs), shared, window, every=True)
    return _digest(found.select("doc_id", "n_words", *[F.array(c).alias(c) for c in ("begins", "ends", "items")]), share)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int | None = 20) -> DataFrame:
    """The documents that aren't contaminated, with all their columns; each is searched where it is read.

    With no `share` any hit drops a document, however long it is. More items than ITEMS_BYTES are
    searched in groups, as in find_contamination. Defined results: documents with null or blank text
    stay, whatever their doc_id; repeated rows are judged alike; an empty table or an empty benchmark
    drops nothing; names of other columns do not matter.
    """
    small_batches(docs.sparkSession)
    n, groups = _item_groups(benchmark)
    if n > 1:
        stored = settle(_with_rows(docs, F.struct(*docs.columns).alias("own")))
        found = _over_groups(stored.select("row", "doc_id", "raw"), groups, window)
        covered = F.expr("size(array_distinct(flatten(transform(flatten(begins), (b, i) -> sequence(b, flatten(ends)[i] - 1)))))")
        bad = found.where(F.size(F.flatten("begins")) > 0)
        bad = bad if share is None else bad.where(covered * share >= F.col("n_words"))
        return stored.join(bad.select("row"), "row", "left_anti").select("own.*")
    shared = docs.sparkSession.sparkContext.broadcast(next(groups))

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = windows_of(shared.value, window)
        for texts in batches:
            yield pd.Series([not _contaminated(words_of(t.encode() if isinstance(t, str) else None), found, share) for t in texts], dtype=bool)

    return docs.where(clean(F.col("text")))


def _contaminated(words: list[bytes], searchers: list[WuManber], share: int | None) -> bool:
    hit = set()
    for s in searchers:
        for at, _ in s.search(words):
            if share is None:
                return True
            hit.update(range(at, at + s.length))
    return bool(hit) and share * len(hit) >= len(words)
