import numpy as np
import pytest

from verbatim.functions.english import EnglishTokenizer, align
from verbatim.operators import annotate, evaluate
from verbatim.operators.tagger import AffixTrie, Forest, Model, normalize, viterbi
from verbatim.plans.registry import sample_model

ABBREVIATIONS = ["Mr.", "Mrs.", "Dr.", "U.S.", "etc.", "i.e.", "e.g.", "Ave."]


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("The quick brown fox jumps.", "The quick brown fox jumps ."),
        ("I don't know what he'll say.", "I do n't know what he 'll say ."),
        ("Mr. Smith said hello.", "Mr. Smith said hello ."),
        ("I live in the U.S.A. now.", "I live in the U.S.A. now ."),
        ("Well...maybe", "Well ... maybe"),
        ("Hello <b>world</b>!", "Hello <b> world </b> !"),
        ('"Hi," he said.', '" Hi , " he said .'),
        ("See (above) for details.", "See ( above ) for details ."),
        ("", ""),
        ("a < b", "a < b"),
        ("yes--no--", "yes--no --"),
        ("n't", "n't"),
    ],
)
def test_english_tokens(text, tokens):
    assert EnglishTokenizer(ABBREVIATIONS).tokenize(text) == tokens.split()


def test_align():
    assert align(["I", "do", "n't", "know", "."], "I don't know.")[1:3] == [(2, 4), (4, 7)]
    assert align(["a", "missing", "b"], "a b") == [(0, 1), (1, 1), (2, 3)]


def model(**more):
    return Model(["SENT", "NN", "CD", "JJ", "NP", "VB"], {"book": [(1, 0.7, "book"), (5, 0.3, "book")]}, **more)


def test_unknown_words():
    m = model()
    assert m.candidates("123456789") == [(2, 1.0, None)]
    assert m.candidates("39th") == [(3, 1.0, None)]
    assert m.candidates("XLIV") == [(4, 1.0, None)]
    assert m.candidates("BOOK") == m.candidates("book")
    assert len(m.candidates("")) == 1 and m.candidates("")[0][1] == 1.0
    m = model(suffixes=AffixTrie({"gni": {5: 0.8, 1: 0.2}, "s": {1: 1.0}}))
    boosted = dict((t, p) for t, p, _ in m.candidates("Running"))
    assert max(boosted, key=boosted.get) == 4
    assert dict((t, p) for t, p, _ in m.candidates("going")) == {5: 0.8, 1: 0.2}
    assert sum(p for _, p, _ in m.candidates("zzz")) == pytest.approx(1)


def test_normalize():
    assert normalize([]).tolist() == [] and normalize([0, 0]).tolist() == [0, 0]
    assert normalize([1, 1, 2])[2] == 0.5


def test_tree_walk():
    tree = Forest.from_preorder([("inner", 0, 0), ("inner", 1, 1), ("leaf", 100, [1]), ("leaf", 300, [1]), ("inner", 0, 2), ("leaf", 200, [1]), ("leaf", 400, [1])])
    assert Forest.leaf(tree, (0, 1)).weight == 100
    assert Forest.leaf(tree, (2, 0)).weight == 200
    assert Forest.leaf(tree, (0, 0)).weight == 300
    assert Forest.leaf(tree, ()).weight == 400


def test_viterbi_follows_the_tree():
    forest = Forest([Forest.from_preorder([("inner", 1, 1), ("leaf", 1, [0.7, 0.2, 0.1]), ("leaf", 1, [0.1, 0.7, 0.2])])])
    flat = np.ones(3) / 3
    both = [(0, 0.5, None), (1, 0.5, None)]
    assert [t for t, _, _ in viterbi([[(1, 1.0, None)], both], forest, 2, flat)] == [1, 0]
    assert [t for t, _, _ in viterbi([[(0, 1.0, None)], both], forest, 2, flat)] == [0, 1]
    assert viterbi([], forest, 2, flat) == []


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(3)
    records = [("inner", 0, 1), ("inner", 1, 2), ("leaf", 3, rng.dirichlet(np.ones(3))), ("leaf", 2, rng.dirichlet(np.ones(3))), ("leaf", 5, rng.dirichlet(np.ones(3)))]
    forest, prior = Forest([Forest.from_preorder(records)]), np.array([0.2, 0.3, 0.5])
    from itertools import product

    for n in range(1, 6):
        options = [[(t, p, None) for t, p in enumerate(rng.dirichlet(np.ones(3)))] for _ in range(n)]
        def score(path):
            total, a, b = 0.0, 0, 0
            for i, t in enumerate(path):
                total += np.log(options[i][t][1]) + np.log(forest.predict((a, b))[t]) - np.log(prior[t])
                a, b = b, t
            return total
        best = max(product(range(3), repeat=n), key=score)
        assert tuple(t for t, _, _ in viterbi(options, forest, 0, prior, 0.0)) == best


def test_tree_annotator_and_lexicon(spark):
    docs = spark.createDataFrame([(0, "d", "The dog's going."), (1, "e", None)], "doc_id long, path string, text string")
    rows = annotate.TreeAnnotator(sample_model()).annotate(docs).orderBy("doc_id").collect()
    assert [t["word"] for t in rows[0]["tokens"]] == ["The", "dog", "'s", "going", "."]
    assert rows[0]["tokens"][-1]["pos"] == "SENT" and rows[1]["tokens"] == []
    tokens = spark.createDataFrame([(0, 0, "The"), (0, 1, "zebra"), (0, 2, "of")], "doc_id long, position int, word string")
    lexicon = spark.createDataFrame([("the", 0, "DT", 1.0, "the"), ("of", 1, "IN", 0.5, "of"), ("of", 2, "RP", 0.5, "of")], "word string, tag_id int, tag string, prob double, lemma string")
    got = annotate.tag_by_lexicon(tokens, lexicon).orderBy("position").collect()
    assert [r["pos"] for r in got] == ["DT", None, "RP"]


def test_diff(spark):
    cols = "doc_id long, position int, word string, pos string, lemma string"
    a = spark.createDataFrame([(0, 0, "a", "X", "a"), (0, 1, "b", "Y", None), (0, 2, "c", "Z", "c"), (0, 3, "d", "Z", "d")], cols)
    b = spark.createDataFrame([(0, 0, "a", "X", "a"), (0, 1, "b", "Q", None), (0, 2, "c", "Z", "x")], cols)
    r = evaluate.accuracy(evaluate.tagger_diff(a, b)).first()
    assert (r["compared"], r["matches"], r["pos_errors"], r["lemma_errors"], r["word_errors"]) == (3, 1, 1, 1, 0)
    assert r["pos_accuracy"] == pytest.approx(2 / 3)


def test_model_from_tables(spark):
    from verbatim.operators.tagger import model_from_tables

    tags = spark.createDataFrame([(0, "SENT"), (1, "DT"), (2, "NN")], "tag_id int, tag string")
    lexicon = spark.createDataFrame([("the", 1, 1.0, "the"), (".", 0, 1.0, ".")], "word string, tag_id int, prob double, lemma string")
    affixes = spark.createDataFrame([("suffix", "g", 2, 1.0)], "kind string, affix string, tag_id int, prob double")
    tree = spark.createDataFrame([(0, 0, 1, 1, 1, 2, None, None), (0, 1, None, None, None, None, 2.0, [0.1, 0.1, 0.8]), (0, 2, None, None, None, None, 1.0, [0.4, 0.3, 0.3])], "tree int, node int, ctx int, tag int, yes int, no int, weight double, probs array<double>")
    m = model_from_tables(tags, lexicon, affixes, tree)
    assert m.tag(["the", "dog", "."]) == [("DT", "the"), ("NN", None), ("SENT", ".")]
    assert model_from_tables(tags, lexicon).tag(["the"]) == [("DT", "the")]
