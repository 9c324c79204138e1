import hashlib
import os
import re
import zlib

import numpy as np
import pytest

from verbatim.llm import ann, decontaminate, html, langid, sharding
from verbatim.llm.wumanber import WuManber

from .helpers import EDGES, edge_docs, empty_docs, frame, some_texts


# sharding


def check_shards(rows, got, shards=16):
    by_shard = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    counts = [len(by_shard.get(k, [])) for k in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    want = sorted(str((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for d, t in rows)
    assert sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in got) == want


@pytest.mark.parametrize("n", [1, 2, 3, 17, 250])
def test_sharding(spark, n):
    texts = some_texts(n, seed=n)
    df = frame(spark, texts)
    got = sharding.shard_documents(df).collect()
    check_shards(list(enumerate(texts)), got)
    assert sorted(r["position"] for r in got) == list(range(n))
    again = sharding.shard_documents(df.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) or n > 1 and sorted((r["doc_id"], r["shard"], r["slot"]) for r in got) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in again)


def test_sharding_edges(spark, tmp_path):
    got = sharding.shard_documents(edge_docs(spark)).collect()
    check_shards(EDGES, got)
    assert sharding.shard_documents(empty_docs(spark)).count() == 0
    docs = frame(spark, some_texts(20))
    sharding.write_shards(sharding.shard_documents(docs, shards=3), docs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


@pytest.mark.parametrize("rows", [1, 2, 5, 100, 101, 997])
def test_feistel_is_a_permutation(spark, rows):
    got = sharding.shuffle_positions(spark.range(rows).withColumnRenamed("id", "row_number"), rows, 3).collect()
    assert sorted(r["position"] for r in got) == list(range(rows))
    if rows > 90:
        assert sum(r["position"] == r["row_number"] for r in got) < rows / 5


# decontamination


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(rows, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n and i is not None else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("group", [16 << 20, 200])
def test_decontamination(spark, monkeypatch, group):
    monkeypatch.setattr(decontaminate, "ITEMS_BYTES", group)
    texts = some_texts(60, words=50)
    long = [t.split() for t in texts if len(t.split()) > 40]
    items = [(k, " ".join(w[k : k + 20])) for k, w in enumerate(long[:10])] + [(20, long[0][3]), (21, " ".join(long[1][2:4])), (22, " ".join(long[2][5:8]).upper()), (23, ""), (24, None), (25, "!!"), (20, "a b"), (None, "the")]
    rows = list(enumerate(texts)) + EDGES[4:]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(docs, bench).collect()
    want = brute_hits(rows, items)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not x[-1] for x in want)
    assert decontaminate.drop_contaminated(docs, bench, share=None).count() == sum(not x[2] for x in want)
    clash = docs.selectExpr("*", "1 as row", "text as raw", "doc_id as own", "array(1) as begins")
    assert decontaminate.drop_contaminated(clash, bench).columns == clash.columns
    assert decontaminate.drop_contaminated(clash, bench).count() == kept.count() and decontaminate.find_contamination(clash, bench).count() == len(rows)
    assert decontaminate.drop_contaminated(docs.where("false"), bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.where("false")).count() == len(rows)


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "looked at the dog"), (2, "日本語 é")], "item_id long, text string")
    got = decontaminate.find_contamination(edge_docs(spark), bench).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_hits(EDGES, [(1, "looked at the dog"), (2, "日本語 é")])))
    assert decontaminate.find_contamination(empty_docs(spark), bench).count() == 0
    assert decontaminate.find_contamination(edge_docs(spark), bench.where("false")).where("contaminated").count() == 0


def test_wu_manber_finds_overlaps():
    s = WuManber({(b"a", b"b", b"a"): [0], (b"b", b"a", b"b"): [1]}, 3)
    assert s.search([b"a", b"b", b"a", b"b", b"a"]) == [(0, [0]), (1, [1]), (2, [0])]
    assert s.search([b"a"]) == [] and s.search([]) == []


# language


def languages(n=120):
    import random

    rng = random.Random(3)
    alphabets = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "er"], "cc": ["ção", "nh", "os", "ar"]}
    rows = []
    for k in range(n):
        lang = rng.choice(sorted(alphabets))
        rows.append((k, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))), lang))
    return rows


def test_language(spark):
    rows = languages()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    for d, _, lang in rows:
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= got[d]["score"] <= 1
    held = [(got[d]["lang_pred"], lang) for d, _, lang in rows if got[d]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    # what may not be learned from changes nothing
    other = [(d, t, "zz" if zlib.crc32(str(d).encode()) % 4 == 2 else x) for d, t, x in rows]
    again = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(other, docs.schema)).collect()}
    assert again == got


def test_language_edges(spark):
    rows = [(d, t, "en" if k % 2 else None) for k, (d, t) in enumerate(EDGES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs).collect()
    assert len(got) == len(EDGES)
    for d, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            assert any(r["doc_id"] == d and (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False) for r in got)
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", docs.lang.substr(9, 1).substr(5, 0)).where("false")).collect()} == set()
    nothing = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert langid.identify(nothing).first()["lang_pred"] == "und"
    clash = docs.selectExpr("*", "1 as __h", "2 as __before", "'s' as score", "true as accepted")
    kept = langid.keep_identified(clash)
    assert kept.columns == clash.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["accepted"])
    assert langid.keep_identified(docs.where("false")).count() == 0 == langid.keep_identified(nothing).count()


def test_language_sample_is_bounded_by_bytes(spark, monkeypatch):
    rows = languages()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(langid, "train", lambda texts, langs: seen.append(texts))
    langid.fit(docs)
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 2000)
    langid.fit(docs)
    whole, part = seen
    assert len(whole) == sum(zlib.crc32(str(d).encode()) % 4 != 2 for d, _, _ in rows)
    assert part == whole[: len(part)] and len("".join(part[:-1]).encode()) < 2000 <= len("".join(part).encode())


def test_slices_of_a_batch_are_judged_like_the_whole(spark, monkeypatch):
    docs = spark.createDataFrame(languages(), "doc_id long, text string, lang string")
    model = langid.fit(docs)
    want = sorted(r["doc_id"] for r in langid.identify(docs, model).where("accepted").collect())
    assert want and sorted(r["doc_id"] for r in langid.keep_identified(docs, model).collect()) == want


# nearest neighbours


def vectors(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    return [(k, (centres[k % 8] + 0.7 * rng.normal(size=dim)).tolist()) for k in range(n)]


@pytest.mark.parametrize("n, shard", [(900, 8192), (900, 200)])
def test_nearest(spark, monkeypatch, n, shard):
    monkeypatch.setattr(ann, "SHARD_ROWS", shard)
    monkeypatch.setattr(ann, "QUERY_ROWS", 20)
    df = spark.createDataFrame(vectors(n), "vec_id long, embedding array<double>")
    found = ann.nearest(df)
    rows = found.collect()
    assert len(rows) == len([k for k in range(n) if k % 20 == 0]) * 20
    x = dict(vectors(n))
    for r in rows[:200]:
        assert r["query_id"] != r["vec_id"] and r["score"] == pytest.approx(np.dot(x[r["query_id"]], x[r["vec_id"]]), abs=1e-12)
    assert ann.recall(found, df) >= 0.9


def test_every_code_within_the_pigeonhole_radius_is_found():
    x = np.array([v for _, v in vectors(600)])
    coder = ann.fit(x, float(np.sqrt((x * x).sum(1).max())))
    codes = coder.codes(x[:40], False)
    for probe in (0, 1, 3):
        coder.probe, coder.radius = probe, (probe + 1) * ann.SUBSTRINGS - 1
        shard = ann.Shard(coder, np.arange(len(x)), x)
        for code in codes:
            assert shard.within(code).tolist() == np.flatnonzero(np.bitwise_count(shard.codes ^ code).sum(1) <= coder.radius).tolist()
            assert shard.probed(code).tolist() == np.flatnonzero(np.bitwise_count(shard.codes ^ code).min(1) <= probe).tolist()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_recall_over_the_embeddings(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert ann.recall(ann.nearest(vectors), vectors) >= 0.9
    x = np.array([r["embedding"] for r in vectors.collect()], float)
    shard = ann.Shard(ann.fit(x, 1.0), np.arange(len(x)), x)
    codes = shard.coder.codes(x[::20], False)
    assert sum(len(shard.within(c)) for c in codes) < 0.15 * len(codes) * len(x)


def test_nearest_edges(spark):
    v = [1.0, 2.0, 0.5]
    rows = [(0, v), (20, v), (1, v), (2, None), (3, [0.0, 0.0, 0.0]), (4, [float("nan"), 1.0, 1.0]), (5, [float("inf"), 1.0, 1.0]), (6, [None, 1.0, 1.0]), (None, v), (7, [1.0]), (1, v), (40, None)]
    df = spark.createDataFrame([(a, b, 1, 2.0, 3) for a, b in rows], "vec_id long, embedding array<double>, rank int, score double, shard int")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 5.25), (0, 2, 1, 5.25), (0, 3, 20, 5.25), (20, 1, 0, 5.25), (20, 2, 1, 5.25), (20, 3, 1, 5.25)]
    assert ann.nearest(df.where("false")).count() == 0
    assert ann.nearest(df.where("vec_id = 20")).count() == 0


# pages


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b", "a\n\nb"),
        ("<div>a</div><div>b <b>c</b>d</div>", "a\nb cd"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "- a\n- b\n  - c\n\nd"),
        ("<ol start=3><li>a</li><li>b</li></ol>", "3. a\n4. b"),
        ("<table><tr><th>n<th>value<tr><td>long one<td>1</table>", "n         value\nlong one  1"),
        ("<head><title>t</title></head><script>var a='</p>'</script>x<style>p{}</style>", "x"),
        ("<p hidden>a</p><p style='color:red; DISPLAY : none'>b</p><p>c</p>", "c"),
        ("a<!-- <p>no</p> -->b", "ab"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<pre>a\n  b</pre>", "a\n  b"),
        ("<p>a</div></b></p>b", "a\n\nb"),
        ("<select><option>x</select>y", "y"),
        ("a < b and <3", "a < b and <3"),
        ("<details>x</details><dialog>no</dialog>", "x"),
        ("<blockquote>q</blockquote>r", "  q\n\nr"),
        ("<p>a <span>b</span> <i> c</i></p>", "a b c"),
    ],
)
def test_pages(page, text):
    assert html.extract(page) == text


def test_deep_and_broken_pages_lose_no_text(spark):
    assert html.extract("<div>" * 5000 + "deep" + "</div>" * 5000 + "after").split() == ["deep", "after"]
    assert html.extract("<table><tr><td>" * 300 + "x").strip() == "x"
    assert html.extract("<a href='x>unclosed") == "unclosed"
    rows = [(1, "<p>a"), (1, "<p>a"), (2, None), (None, "b")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, html string, text string")
    got = html.extract_pages(pages).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "a"), (1, "a"), (2, ""), (None, "b")]))
    assert html.extract_pages(pages.where("false")).count() == 0
