import pytest
from pyspark.sql import functions as F

from verbatim.functions import words as W
from verbatim.operators import collocates, frequency, kwic
from verbatim.operators.corpus import Corpus
from verbatim.schema import CORPUS, KwicRequest


def corpus(spark, *texts):
    docs = spark.createDataFrame([(i, f"d{i}", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    return Corpus.from_documents(docs)


def lines(df):
    return [(r["left"], r["hit"], r["right"]) for r in df.orderBy("doc_id", "position").collect()]


@pytest.mark.parametrize(
    "text, term, context, expected",
    [
        ("the quick brown fox jumps over the lazy dog", "the", 2, [("", "the", "quick brown"), ("jumps over", "the", "lazy dog")]),
        ("The quick brown fox jumps over THE lazy dog", "the", 1, [("", "The", "quick"), ("over", "THE", "lazy")]),
        ("alpha beta gamma delta target epsilon zeta eta theta iota", "target", 2, [("gamma delta", "target", "epsilon zeta")]),
        ("target one two three", "target", 10, [("", "target", "one two three")]),
        ("a target b", "target", 0, [("", "target", "")]),
        ("...", "x", 3, []),
        ("", "x", 3, []),
        ("some words", "", 3, []),
    ],
)
def test_lines(spark, text, term, context, expected):
    assert lines(corpus(spark, text).kwic(term, context=context)) == expected


def test_layers_of_unannotated_text(spark):
    c = corpus(spark, "the quick brown fox")
    assert lines(c.kwic("quick", context=1)) == [("the", "quick", "brown")]
    assert c.kwic("quick", "lemma").count() == 0
    assert c.kwic("NN", "pos").count() == 0


def test_layers_stay_aligned_with_punctuation(spark):
    rows = [(0, "d", "Well, dogs ran.", True, [("Well", "well", "UH", 0, 4), (",", ",", ",", 4, 5), ("dogs", "dog", "NNS", 6, 10), ("ran", "run", "VBD", 11, 14), (".", None, "SENT", 14, 15)])]
    c = Corpus(spark.createDataFrame(rows, CORPUS))
    assert lines(c.kwic("NNS", "pos", 1)) == [(",", "dogs", "ran")]
    assert lines(c.kwic("RUN", "lemma", 1)) == [("dogs", "ran", ".")]
    assert c.kwic("nns", "pos").count() == 0


def test_limit_takes_the_first_hits(spark):
    c = corpus(spark, "x x x", "x x")
    assert [(r["doc_id"], r["position"]) for r in c.kwic("x", limit=4).collect()] == [(0, 0), (0, 1), (0, 2), (1, 0)]
    assert c.kwic("x", limit=0).count() == 0
    assert kwic.truncated(4, 4) and not kwic.truncated(3, 4)


def test_array_and_window_forms_agree(spark):
    c = corpus(spark, "the cat and the dog saw the bird", "no such word", "the", "a the the b")
    tokens = c.df.select("doc_id", F.posexplode("tokens.word").alias("position", "word"))
    a = c.kwic("the", context=2).drop("path").orderBy("doc_id", "position").collect()
    b = kwic.kwic_by_windows(tokens, "the", 2).select("doc_id", "position", "left", "hit", "right").orderBy("doc_id", "position").collect()
    assert a == b


def test_orders(spark):
    c = corpus(spark, "b x d", "a x c", "c x b")
    get = lambda mode, d=False: [r["doc_id"] for r in kwic.sort_lines(c.kwic("x", context=1), mode, d).collect()]
    assert get("left1") == [1, 0, 2]
    assert get("right1") == [2, 1, 0]
    assert get("doc", True) == [2, 1, 0]
    with pytest.raises(ValueError):
        get("other")


def test_density_and_dispersion(spark):
    hits = spark.createDataFrame([(0, p) for p in (0, 10, 20, 30, 40)], "doc_id long, position int")
    assert [r["hits"] for r in kwic.density(hits, 5).orderBy("bucket").collect()] == [1, 1, 1, 1, 1]
    assert [r["hits"] for r in kwic.density(hits.where("false"), 3).orderBy("bucket").collect()] == [0, 0, 0]
    c = corpus(spark, "x a b x")
    assert [(r["mark"], r["hits"]) for r in c.dispersion("x").orderBy("mark").collect()] == [(0, 1), (75, 1)]


def test_spans_slice_back(spark):
    texts = ["Hello, world!", "Pražák píše", "don't 3.14 _ __ x_y", "", "¡" + "añb " * 300, "…"]
    for row in corpus(spark, *texts).df.select("text", "tokens").collect():
        raw = row["text"].encode()
        assert [raw[t["byte_start"] : t["byte_end"]].decode() for t in row["tokens"]] == [t["word"] for t in row["tokens"]]
    first = corpus(spark, "Hello, world!").df.first()["tokens"]
    assert [(t["word"], t["byte_start"], t["byte_end"]) for t in first] == [("Hello", 0, 5), ("world", 7, 12)]


def test_collocates_filter_before_they_cut(spark):
    c = corpus(spark, "far 7 a near node one 22 two three")
    got = {r["word"]: (r["left_count"], r["right_count"]) for r in c.collocates("node", left=1, right=3).collect()}
    assert got == {"near": (1, 0), "one": (0, 1), "two": (0, 1)}
    got = {r["word"] for r in c.collocates("node", left=2, right=4).collect()}
    assert got == {"far", "near", "one", "two", "three"}  # "far" is four words away: two were dropped first
    assert {r["word"] for r in c.collocates("node", left=2, right=2).collect()} == {"near", "one"}
    with pytest.raises(ValueError):
        c.collocates("node", left=0, right=0)


def test_collocates_count_the_node_and_break_ties_by_word(spark):
    rows = corpus(spark, "bb aa node node cc").collocates("node", left=2, right=2, limit=3).collect()
    assert [(r["word"], r["total"]) for r in rows] == [("aa", 2), ("cc", 2), ("node", 2)]
    assert rows[0]["log_dice"] == rows[0]["mi"] == rows[0]["z"] == pytest.approx(1.584962500721156)
    s = collocates.summary(corpus(spark, "bb aa node node cc").df, "node", left=2, right=2).first()
    assert (s["node_hits"], s["window_tokens"]) == (2, 7)


def test_frequency(spark):
    c = corpus(spark, "The cat the dog", "cat")
    assert {r["word"]: (r["count"], r["pct"]) for r in c.frequency().collect()} == {"the": (2, 40.0), "cat": (2, 40.0), "dog": (1, 20.0)}
    assert [(r["doc_id"], r["hits"], r["per_million"]) for r in c.doc_frequency("cat").collect()] == [(1, 1, 1e6), (0, 1, 250000.0)]
    s = frequency.stats(c.df).first()
    assert (s["doc_count"], s["byte_count"], s["token_count_estimate"], s["avg_doc_len"]) == (2, 18, 3, 9)
    assert frequency.stats(c.df.where("false")).first()["avg_doc_len"] == 0
    v = frequency.vocabulary(c.df).first()
    assert (v["tokens"], v["types"]) == (5, 3)


def test_requests():
    r = KwicRequest("x")
    assert (r.layer, r.context, r.limit) == ("word", 7, 50)
    assert r.with_layer("pos").with_context(0).with_limit(3) == KwicRequest("x", "pos", 0, 3)
    assert r.with_context(0).with_limit(0).interactive() == KwicRequest("x", "word", 7, 50)
    with pytest.raises(ValueError):
        r.with_layer("other")


@pytest.mark.parametrize("name, slug", [("Gutenberg · EN", "gutenberg-en"), ("  spaces  ", "spaces"), ("a/b/c", "a-b-c"), ("éclair", "clair"), ("---", "corpus"), ("", "corpus"), ("my_corpus-1", "my_corpus-1")])
def test_slugs(spark, name, slug):
    from verbatim.sources.catalog import slugify

    assert slugify(name) == slug
    assert spark.createDataFrame([(name,)], "n string").select(W.slug(F.col("n"))).first()[0] == slug


def test_small_functions(spark):
    row = spark.sql("SELECT 1L AS l, 3L AS r").select(W.preference(F.col("l"), F.col("r")), W.preference(F.lit(0), F.lit(0))).first()
    assert tuple(row) == (0.5, 0.0)
    tags = spark.createDataFrame([(t,) for t in ("NNS", "VBD", "MD", "JJR", "RB", "DT")], "t string")
    assert [r[0] for r in tags.select(W.pos_family(F.col("t"))).collect()] == ["noun", "verb", "verb", "adj", "adv", "function"]
    assert (W.duration(0.5), W.duration(42.3), W.duration(1500)) == ("500 µs", "42.3 ms", "1.50 s")
    assert (W.build_time(15_000), W.build_time(95_000), W.thousands(1234567)) == ("15.0 s", "1:35", "1,234,567")
    text = "x *** START OF THE PROJECT GUTENBERG EBOOK Q ***\n body \n*** END OF PROJECT GUTENBERG more"
    assert spark.createDataFrame([(text,)], "t string").select(W.strip_boilerplate(F.col("t"))).first()[0] == "body"


def test_sql_functions(spark):
    c = corpus(spark, "the cat saw the dog")
    c.register("sample_corpus")
    got = spark.sql("SELECT position, left, hit, right FROM sample_corpus_kwic('THE', 1) ORDER BY position").collect()
    assert [tuple(r) for r in got] == [(0, "", "the", "cat"), (3, "saw", "the", "dog")]
    assert spark.sql("SELECT n FROM sample_corpus_frequency() WHERE word = 'the'").first()[0] == 2
