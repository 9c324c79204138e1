import random

import numpy as np
import pytest

import corpus_pipeline
from verbatim.llm import similar

from .helpers import some_texts


def brute_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    return out


def brute_groups(texts):
    """The smallest place that chains of Jaccard >= 0.8 connect each text with."""
    sets, root = brute_sets(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both * 5 >= len(sets[i] | sets[j]) * 4 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def planted_texts():
    """Some texts, and copies of long ones at similarities on both sides of 0.8."""
    rng, out = random.Random(3), some_texts(150, seed=9)
    for k in range(60):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        out.append(" ".join(w))
        for at in rng.sample(range(len(w)), max(1, len(w) * (k % 5 + 1) // 100)):
            w[at] = "changed"
        out.append(" ".join(w))
    return out


def test_near_dedup_stage_against_brute_force_jaccard(spark, tmp_path):
    texts = planted_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()}
    assert got == set(brute_groups(texts))


@pytest.mark.parametrize("most", [2, 7])
def test_large_buckets_are_dealt_by_pairs_of_parts_and_lose_no_link(spark, most, monkeypatch):
    rng = random.Random(most)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(60):
        w = list(base)
        w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts.append(" ".join(base))
    monkeypatch.setattr(similar.near_links, "__defaults__", (most,))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in similar.drop_near_duplicates(docs).collect()} == set(brute_groups(texts))


@pytest.mark.parametrize(("chunk", "bits"), [(1 << 20, 24), (40, 3)])
def test_bound_loses_no_link(monkeypatch, chunk, bits):
    """Near copies in one shard: groups as all pairs give them, also with a table so small that hashes collide."""
    monkeypatch.setattr(similar, "CHUNK", chunk)
    monkeypatch.setattr(similar, "MARK_BITS", bits)
    rng = np.random.default_rng(bits)
    for size in (1, 4, 9, 40):
        sets = []
        for _ in range(3):
            base = rng.integers(0, 1 << 64, size, np.uint64)
            for _ in range(30):
                x, n = base.copy(), int(rng.integers(0, size // 3 + 2))
                x[rng.choice(size, min(n, size), replace=False)] = rng.integers(0, 1 << 64, min(n, size), np.uint64)
                sets.append(np.unique(x))
        links = similar.tree_links([similar.vote(x) for x in sets], sets, 64)
        got, want = list(range(len(sets))), list(range(len(sets)))
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) * 5 >= len(np.union1d(sets[i], sets[j])) * 4]
        for root, found in ((got, links), (want, pairs)):
            for i, j in found:
                a, b = sorted((root[i], root[j]))
                root[:] = [a if r == b else r for r in root]
        assert got == want
        assert len(links) == len(sets) - len(set(got))


def test_tree_links():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 64, 12, np.uint64)
    sets = [np.unique(pool[rng.integers(0, 12, rng.integers(1, 14))]) for _ in range(60)]
    root = list(range(60))
    links = similar.tree_links([similar.vote(x) for x in sets], sets, 64)
    for i, j in links:
        a, b = sorted((root[i], root[j]))
        root = [a if r == b else r for r in root]
    for i in range(60):
        for j in range(60):
            x, y = set(sets[i].tolist()), set(sets[j].tolist())
            assert len(x & y) / len(x | y) < 0.8 or root[i] == root[j]
    assert all(len(set(sets[i]) & set(sets[j])) * 5 >= len(set(sets[i]) | set(sets[j])) * 4 for i, j in links)


@pytest.mark.parametrize("n, other", [(4, 5), (8, 10), (40, 50), (400, 500)])
def test_the_radius_reaches_texts_at_the_least_similarity(n, other):
    rng = np.random.default_rng(n)
    for _ in range(3000):
        x = rng.integers(0, 1 << 64, other, np.uint64)
        assert (similar.vote(x) ^ similar.vote(x[:n])).bit_count() <= similar.RADIUS


@pytest.mark.parametrize("few", [1 << 18, 0])
def test_rows_are_judged_by_id_and_text(spark, few, monkeypatch):
    monkeypatch.setattr(similar, "BROADCAST_CLASSES", few)
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcde")
    rows = [(1, a), (2, a), (2, b), (2, b), (3, c), (3, d), (None, d), (None, e), (None, e), (None, e.replace("e59", "E59")), (4, None), (None, " \n"), (5, "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, __rep int").repartition(3)
    got = similar.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = sorted((str(r["doc_id"]), (r["text"] or "").lower()) for r in got.collect())
    assert kept == sorted([("1", a), ("2", b), ("3", c), ("3", d), ("None", e), ("4", "")])
    assert similar.drop_near_duplicates(docs.where("false")).count() == 0
