"""Work and memory that must not grow with the size of a batch, a document or a table."""

import pyarrow as pa
import pytest

from verbatim.operators import annotate
from verbatim.plans.registry import sample_model

TEXTS = ["The dog's going.", None, "", "one two three four five six seven", "of the"]


def batch():
    return pa.RecordBatch.from_pydict({"doc_id": pa.array([0, 1, 2, None, 4], pa.int64()), "text": pa.array(TEXTS)})


@pytest.mark.parametrize("most", [1, 3, 5, 1000])
def test_python_gives_tokens_in_batches_of_bounded_size(most):
    annotator = annotate.TreeAnnotator(sample_model())
    cut = lambda text: annotate._layers(annotator.model, annotator.tokenizer, text)
    want = [(i, k, w) for i, t in zip([0, 1, 2, None, 4], TEXTS) for k, w in enumerate(annotator.tokenizer.tokenize(t or ""))]
    parts = list(annotate.row_batches(iter([batch(), batch()]), cut, ("word", "pos"), most))
    assert max(p.num_rows for p in parts) <= most
    assert [(r["doc_id"], r["position"], r["word"]) for p in parts for r in p.to_pylist()] == want * 2
    parts = list(annotate.array_batches(iter([batch()]), cut, most))
    assert all(sum(len(t) for t in p.column("tokens").to_pylist()[:-1]) < most for p in parts)
    assert [(r["doc_id"], k, t["word"]) for p in parts for r in p.to_pylist() for k, t in enumerate(r["tokens"])] == want
    assert [len(r["tokens"]) for p in parts for r in p.to_pylist()] == [5, 0, 0, 7, 2]


def test_words_of_one_ending_share_their_candidates():
    model = sample_model()
    found = model.options([f"w{chr(97 + k)}ing" for k in range(20)])
    assert len({id(x) for x in found}) == 1


def test_equal_steps_are_worked_out_once():
    model = sample_model()
    model.tag(["the", "dog", "of", "going", "."] * 2000)
    assert next(iter(model.forest.moves.values())).made < 100


def test_spans_of_any_length(spark):
    """Ends by a running sum in Python; words without letters and numbers are dropped, a null text stays null."""
    from pyspark.sql import functions as F

    from verbatim.functions import words as W

    sizes = [*range(0, 70), 255, 256, 257, 1023, 1025, 4097, 20_000, 40_000]
    texts = [(n, "".join(("é" * (k % 3)) + "x" + " ¿"[: 1 + k % 2] for k in range(n))) for n in sizes]
    got = W.with_spans(spark.createDataFrame(texts, "n int, text string")).select("n", F.col("tokens.byte_start").alias("a"), F.col("tokens.byte_end").alias("b"))
    assert [r["t"] for r in W.with_spans(spark.createDataFrame([(0, None), (1, "_a _ b\u0301 \u0301"), (2, "a")], "n int, text string")).selectExpr("n", "tokens.word t").orderBy("n").collect()] == [None, ["_a", "b\u0301"], ["a"]]
    for r in got.collect():
        want, at = [], 0
        for k in range(r["n"]):
            size = 2 * (k % 3) + 1
            want.append((at, at + size))
            at += size + len(" ¿"[: 1 + k % 2].encode())
        assert list(zip(r["a"], r["b"])) == want


def test_lines_and_windows_do_not_copy_a_document_for_each_hit(spark):
    """An exploded position beside the words would have Spark copy them a hit: 4000 hits of 8000 words took minutes."""
    import time

    from verbatim.operators import collocates, kwic
    from verbatim.plans.registry import _with_words

    docs = spark.createDataFrame([(k, str(k), "the bb " * 20_000) for k in range(4)], "doc_id long, path string, text string")
    corpus = _with_words(docs)
    plan = kwic.kwic(corpus, "the")._jdf.queryExecution().optimizedPlan().toString()
    generate = next(line for line in plan.splitlines() if "Generate" in line)
    assert "transform(__p" in generate
    start = time.time()
    assert collocates.summary(corpus, "the", max_hits=None).first()["node_hits"] == 80_000
    assert time.time() - start < 30


def test_narrow_side_reaches_further_and_sides_keep_their_names(spark):
    from verbatim.operators import collocates
    from verbatim.plans.registry import _with_words

    corpus = _with_words(spark.createDataFrame([(0, "0", "aa 1 bb 2 the cc 3 dd Ee")], "doc_id long, path string, text string"))
    pairs = lambda l, r, n: sorted((x["side"], x["word"]) for x in collocates.windows(corpus, "the", left=l, right=r, max_hits=n).collect())  # noqa: E731,E741
    for n in (None, 5000):
        assert pairs(1, 4, n) == [("l", "bb"), ("r", "cc"), ("r", "dd"), ("r", "ee")]
        assert pairs(0, 2, n) == [("r", "cc")]
        r = collocates.summary(corpus, "the", left=1, right=4, max_hits=n).first()
        assert (r["node_hits"], r["window_tokens"]) == (1, 4)


def test_tagging_by_suffix_shuffles_no_token_and_both_joins_agree(spark):
    tokens = spark.createDataFrame([(k, w) for k, w in enumerate(["Singing", "ing", "g", "", None, "ations", "x"])], "n int, word string")
    suffixes = spark.createDataFrame([("g", "A"), ("ing", "B"), ("ations", "C"), ("s", "D"), ("", "E"), ("toolong", "F")], "suffix string, tag string")
    broadcast, keyed = (annotate.tag_by_suffix(tokens, suffixes, bound=b) for b in (64 << 20, 0))
    assert [r["pos"] for r in broadcast.orderBy("n").collect()] == ["B", "B", "A", "NN", "NN", "C", "NN"]
    assert broadcast.columns == keyed.columns and sorted(map(str, broadcast.collect())) == sorted(map(str, keyed.collect()))
    plan = broadcast._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 3
    assert {r["pos"] for r in annotate.tag_by_suffix(tokens, suffixes.where("false")).collect()} == {"NN"}


@pytest.mark.parametrize("ids", [[0, 1, 2], [0, 1, 1], [0, None, 2], [5, 5, None]])
def test_diff_of_two_taggings_of_one_text(spark, tmp_path, ids):
    """As the SQL joins them, also where documents share an id or have none; alone they are not shuffled."""
    import duckdb

    from verbatim.plans import registry

    rows = [(i, t, "en", "s", len(t)) for i, t in zip(ids, ["The going of the", "of nothing is that", "to", "was"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = registry.QUERIES["tagger_diff"](spark, str(tmp_path))
    assert found.collect()[0].asDict() == pytest.approx(dict(zip(con.sql(registry.SQL["tagger_diff"]).columns, con.sql(registry.SQL["tagger_diff"]).fetchall()[0])))
    if ids == [0, 1, 2]:
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
