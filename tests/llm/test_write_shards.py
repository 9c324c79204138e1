from verbatim.llm import sharding

from .helpers import EDGES, edge_docs


def test_every_row_is_written_with_a_slot_of_its_own(spark, tmp_path):
    docs = edge_docs(spark).select("doc_id", "text").union(spark.createDataFrame([(None, "other"), (4, "clash")], "doc_id long, text string")).repartition(3)
    assigned = sharding.shard_documents(docs, shards=3)
    sharding.write_shards(assigned, docs, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(map(str, [*EDGES, (None, "other"), (4, "clash")]))
    want = {(r["shard"], r["slot"]): (r["doc_id"], r["size"]) for r in assigned.collect()}
    assert {(r["shard"], r["slot"]): (r["doc_id"], len((r["text"] or "").encode()) + 1) for r in got} == want and len(want) == len(got)
