import os

import pytest

import corpus_pipeline

from .helpers import some_texts
from .test_dedup import brute_repeats
from .test_rest import brute_hits
from .test_similar import brute_groups
from .test_tokens import check_packs


def test_stages_against_brute_force(spark, tmp_path):
    texts = some_texts(120, seed=12)
    lang = ["aa" if k % 2 else "bb" for k in range(len(texts))]
    rows = [(k, t, x, "s", len(t)) for k, (t, x) in enumerate(zip(texts, lang))] + [(900, "123 456", "aa", "s", 7), (901, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    items = [(1, " ".join(max(texts, key=len).split()[5:30]))]
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / f"stage-{name}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    first = [(r["doc_id"], r["text"]) for r in seen["language_id"]]
    assert {d for d, _ in first} == set(range(len(texts)))
    first.sort()
    assert {r["doc_id"] for r in seen["near_dedup"]} == {first[k][0] for k in set(brute_groups([t for _, t in first]))}
    want = {x[0]: x[1] - x[2] for x in brute_repeats([(r["doc_id"], r["text"]) for r in seen["near_dedup"]])}
    for r in seen["suffix_dedup"]:
        assert len(r["text"].encode()) <= want[r["doc_id"]] <= len(r["text"].encode()) + 6
        assert r["n_chars"] == len(r["text"])
    clean = {x[0] for x in brute_hits([(r["doc_id"], r["text"]) for r in seen["suffix_dedup"]], items) if not x[2]}
    assert {r["doc_id"] for r in seen["decontamination"]} == clean
    check_packs([(r["doc_id"], r["text"]) for r in seen["decontamination"]], seen["packing"], 2048)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_registered_queries_run(spark):
    from verbatim.llm.queries import QUERIES

    for name, f in QUERIES.items():
        assert f(spark, "/root/testdata/sf0.001").count() > 0, name
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_queries_equal_their_sql(spark):
    import duckdb

    from verbatim.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in SQL.items():
        want = con.sql(sql)
        got = QUERIES[name](spark, "/root/testdata/sf0.001").select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()), name
