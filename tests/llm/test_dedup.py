import hashlib
import random
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from verbatim.llm import similar, simhash, suffix_dedup
from verbatim.llm.anchors import LENGTH, anchors
from verbatim.llm.bktree import BKTree, forest_links
from verbatim.llm.components import components
from verbatim.llm.losertree import Run, merge

from .helpers import EDGES, edge_docs, empty_docs, frame, some_texts


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    counts = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(parts))


def groups(ids, fps, radius):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, d in enumerate(ids):
        r = root(i)
        if d is not None and (r not in least or d < least[r]):
            least[r] = d
    return [least.get(root(i)) for i in range(len(ids))]


def test_near_duplicates(spark):
    texts = some_texts(250, seed=4)
    got = simhash.near_duplicates(frame(spark, texts)).orderBy("doc_id").collect()
    fps = [brute_fingerprint(t) for t in texts]
    assert [r["fingerprint"] for r in got] == [f"{x:016x}" for x in fps]
    assert [r["component_id"] for r in got] == groups(range(len(texts)), fps, 3)


@pytest.mark.parametrize("hot", [1, 3, 100])
def test_rows_of_hot_fingerprints_are_named_where_they_are(spark, hot):
    fps = spark.createDataFrame([(k, k % 7 if k < 60 else 7) for k in range(100)], "doc_id long, fp long").repartition(4)
    named = fps.groupBy("fp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    got = simhash.named_rows(fps, named, hot)
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(100))
    assert all(r["component_id"] == (r["doc_id"] % 7 if r["doc_id"] < 60 else 60) for r in got.collect())


def test_near_duplicates_edges(spark):
    got = simhash.near_duplicates(edge_docs(spark)).collect()
    fps = [brute_fingerprint(t) for _, t in EDGES]
    want = list(zip([d for d, _ in EDGES], [f"{x:016x}" for x in fps], groups([d for d, _ in EDGES], fps, 3)))
    assert sorted(map(str, (tuple(r)[:3] for r in got))) == sorted(map(str, want))
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0
    kept = [r["doc_id"] for r in similar.drop_near_duplicates(edge_docs(spark)).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({c for (d, _, c) in want if d is not None}) and kept.count(None) == 1


@pytest.mark.parametrize("most", [3, 20])
def test_large_shards_are_dealt_anew_and_lose_no_link(spark, most):
    rng = random.Random(most)
    base = rng.getrandbits(64)
    fps = list({base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for _ in range(300)})
    signed = [(x - (1 << 64) if x >> 63 else x, k) for k, x in enumerate(fps)]
    classes = spark.createDataFrame(signed, "fp long, rep long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(classes, 3, most)).collect()}
    assert [roots.get(k, k) for k in range(len(fps))] == groups(range(len(fps)), fps, 3)


def test_bk_tree():
    rng = random.Random(1)
    items = list({rng.getrandbits(16) for _ in range(400)})
    tree = BKTree()
    for x in items:
        tree.add(x)
    for q in items[:50]:
        assert sorted(tree.near(q, 3)) == [k for k, x in enumerate(items) if (x ^ q).bit_count() <= 3]
    assert BKTree().near(1, 3) == []
    assert len(forest_links(items, 16)) == len(items) - 1


def test_components_of_a_long_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(100, 160)]
    star = [(5, k) for k in range(1000, 1100)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert all(got[k] == 100 for k in range(101, 161)) and all(got[k] == 5 for k in range(1000, 1100)) and 7 not in got


def brute_repeats(rows):
    seen = {}
    for d, t in rows:
        if d is not None:
            raw = (t or "").encode()
            for w in {raw[i : i + LENGTH] for i in range(len(raw) - LENGTH + 1)}:
                seen[w] = min(d, seen.get(w, d))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - LENGTH + 1) if d is not None else ():
            if seen[raw[i : i + LENGTH]] < d:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        spans = sum(1 for i in range(len(raw)) if gone[i] and (not i or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(raw, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("block, hot", [(300, 256), (4 << 20, 256), (300, 3), (5000, 2)])
def test_repeated_bytes(spark, monkeypatch, block, hot):
    rng = random.Random(9)
    texts = some_texts(80, seed=9, words=60)
    whole = texts[3] + texts[5]
    texts += [whole[k : k + n] for n in (49, 50, 51, 77) for k in range(0, 200, 37)]
    texts += ["ab" * 200, "ab" * 60, "\0" * 120, "\0" * 70 + "x", "a" * 49, "é" * 40, "x" + "é" * 40]
    texts += ["".join(rng.choice("ab") for _ in range(400)) for _ in range(5)]
    line = "This one line of a licence stands in every document that is made here, whatever else it says. "
    texts += [t[: len(t) // 2] + line + t[len(t) // 2 :] for t in some_texts(40, seed=10)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", hot)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in suffix_dedup.repeated_bytes(docs).collect())
    assert got == sorted(brute_repeats(rows))


@pytest.mark.parametrize("hot", [2, 10_000])
def test_repeats_in_several_passes(spark, monkeypatch, hot):
    line = "This one line of a licence stands in every document that is made here, whatever else it says. "
    rows = list(enumerate(t[: len(t) // 2] + line + t[len(t) // 2 :] for t in some_texts(60, seed=11)))
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", hot)
    monkeypatch.setattr(suffix_dedup, "HOT_EACH", 1)
    monkeypatch.setattr(suffix_dedup, "PASS_SHARE", 0.1)
    made, stored = [], suffix_dedup._stored
    monkeypatch.setattr(suffix_dedup, "_stored", lambda df, path: (made.append(path), stored(df, path))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in suffix_dedup.repeated_bytes(docs).collect()) == sorted(brute_repeats(rows))
    kinds = [p.rsplit("/", 1)[1].split("-")[0] for p in made]
    assert kinds.count("answers") > 1 and ("strings" in kinds) == (hot == 2)
    assert not any(Path(p.removeprefix("file:")).exists() for p in made if "/strings-" in p)


def test_a_line_of_many_documents_is_sent_without_its_surroundings():
    rng = random.Random(3)
    line = "This one line of a licence stands in every document that is made here. "
    texts = ["".join(chr(rng.randrange(33, 127)) for _ in range(80)) for _ in range(400)]
    raws = [(a + line + b).encode() for a, b in zip(texts[::2], texts[1::2])]
    whole = b"".join(raws)
    block = suffix_dedup.Block(np.arange(200, dtype="<i8").tobytes(), bytes(200), np.array([len(x) for x in raws], "<i8").tobytes(), whole, suffix_dedup._gaps(whole))
    keys, counts = np.unique(block.anchors(1)[2], return_counts=True)
    own = keys[counts > 1].astype("<u4").tobytes()
    sent = []
    for hot in (own, b""):
        shared = [{"part": 0, "again": 0, "keys": own, "hot": hot}]
        rows = [row for row in suffix_dedup._runs(1, block, shared, [], 1, 0, 1) if row.column("lcps")[0].as_py()]
        sent.append(sum(len(row.column(c)[0].as_py()) for row in rows for c in ("tails", "lefts")))
    assert 0 < 3 * sent[0] < sent[1], sent


def test_repeated_bytes_edges(spark):
    got = suffix_dedup.repeated_bytes(edge_docs(spark)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_repeats(EDGES)))
    assert suffix_dedup.repeated_bytes(empty_docs(spark)).count() == 0
    cleaned = suffix_dedup.remove_repeats(edge_docs(spark))
    assert cleaned.columns == edge_docs(spark).columns and cleaned.count() == len(EDGES)
    assert suffix_dedup.remove_repeats(empty_docs(spark)).count() == 0


def test_every_string_of_the_length_has_the_same_anchor():
    rng = np.random.default_rng(0)
    core = rng.integers(97, 100, LENGTH).astype(np.uint8)
    places = set()
    for k in range(20):
        around = [rng.integers(97, 123, n).astype(np.uint8) for n in (k, 60 - k)]
        at, _ = anchors(np.concatenate([around[0], core, around[1]]))
        own = {int(a) - k for a in at if k <= a <= k + LENGTH - 24}
        assert own
        places = own if k == 0 else places & own
    assert places
    assert len(anchors(np.zeros(10, np.uint8))[0]) == 0


def front_coded(items, payload):
    lcps, tails, ends, before = [], b"", [], b""
    for x in items:
        n = 0
        while n < min(len(x), len(before)) and x[n] == before[n]:
            n += 1
        lcps.append(n)
        tails += x[n:]
        ends.append(len(tails))
        before = x
    return Run(bytes(lcps), ends, tails, payload)


@pytest.mark.parametrize("runs", [1, 2, 3, 7])
def test_loser_tree(runs):
    rng = random.Random(runs)
    lists = [sorted(bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(60))) for _ in range(runs)]
    out = list(merge([front_coded(x, k) for k, x in enumerate(lists)]))
    assert [t for _, t, _ in out] == sorted(sum(lists, []))
    for (_, a, _), (n, b, _) in zip(out, out[1:]):
        assert a[:n] == b[:n] and (len(a) == n or len(b) == n or a[n] != b[n])
