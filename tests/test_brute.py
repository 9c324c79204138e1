"""The English tokenizer and the decoder against plain versions of their rules, also over whole documents."""

import itertools
import os
import random
from math import log

import numpy as np
import pytest

from verbatim.functions.english import EnglishTokenizer
from verbatim.operators.kwic import sort_lines
from verbatim.operators.tagger import Forest, viterbi
from verbatim.plans import registry

DATA = "/root/testdata/sf0.001"
FRONT, BACK = set("[¿¡{'`\"‚„†‡‹‘’“”•–—›»«"), set("]}'`\",;:!?؟%‚„…†‡‰‹‘’“”•–—›»«")
ENDINGS = ["s", "re", "ve", "d", "m", "em", "ll"]


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def clitic(word):
    """Length of the clitic at the end that may be cut off, or 0."""
    if len(word) >= 3 and low(word[-3:]) in ("n't", "n’t", "n´t"):
        return 3
    for e in ENDINGS:
        n = len(e) + 1
        if len(word) > n and low(word).endswith(e) and word[-n] in "'’´":
            return n
    return 0


def split(word, known):
    out, queue = [], []
    while True:
        if len(word) >= 2 and word[0] == "(" and ")" not in word[:-1]:
            out.append(word[0])
            word = word[1:]
        elif len(word) >= 2 and word[-1] == ")" and "(" not in word[:-1]:
            queue.insert(0, word[-1])
            word = word[:-1]
        elif len(word) >= 2 and word[0] in FRONT:
            out.append(word[0])
            word = word[1:]
        elif len(word) >= 2 and word[-1] in BACK:
            queue.insert(0, word[-1])
            word = word[:-1]
        elif len(word) >= 2 and word[-1] == "." and (word[-2] in BACK or word[-2] == ")"):
            queue.insert(0, ".")
            word = word[:-1]
        else:
            break
    letters = len(word) >= 2 and len(word) % 2 == 0 and all(c == "." if k % 2 else c == "-" or low(c) != c or "a" <= c <= "z" for k, c in enumerate(word))
    if word in known or letters:
        return [*out, word, *queue]
    if len(word) >= 2 and word.endswith(".") and word != "...":
        word = word[:-1]
        queue.insert(0, ".")
        if word in known:
            return [*out, word, *queue]
    while len(word) > 2 and word[:2] == "--":
        out.append("--")
        word = word[2:]
    while len(word) > 2 and word[-2:] == "--":
        queue.insert(0, "--")
        word = word[:-2]
    while n := clitic(word):
        queue.insert(0, word[-n:])
        word = word[:-n]
    return [*out, *([word] if word else []), *queue]


def tokens(text, known):
    out, part, k = [], "", 0

    def close():
        padded, i = "", 0
        while i < len(part):
            if part.startswith("...", i):
                padded, i = padded + " ... ", i + 3
                continue
            padded += part[i]
            i += 1
        spaced = ""
        for i, c in enumerate(padded):
            spaced += c
            if c in ";!?" and i + 1 < len(padded) and not padded[i + 1].isspace():
                spaced += " "
        for word in spaced.split():
            out.extend(split(word, known))

    while k < len(text):
        end = text.find(">", k) if text[k] == "<" else -1
        if end > 0 and "<" not in text[k + 1 : end]:
            close()
            part = ""
            out.append(text[k : end + 1])
            k = end + 1
        else:
            part += text[k]
            k += 1
    close()
    return out


def test_tokenizer_on_made_up_texts():
    rng, pieces = random.Random(4), ["a", "Mr.", "U.S.", "n't", "'ll", "'s", "’re", ".", "...", "(", ")", '"', ",", ";", "!", "--", " ", " ", "<b>", "<", ">", "x", "S", "…", "don't", "[", "etc."]
    tokenizer = EnglishTokenizer(["Mr.", "etc."], most=50)
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert tokenizer.tokenize(text) == tokens(text, {"Mr.", "etc."}), repr(text)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_english_tokenize_over_whole_documents(spark):
    got = {}
    for r in registry.QUERIES["english_tokenize"](spark, DATA).orderBy("doc_id", "position").collect():
        got.setdefault(r["doc_id"], []).append(r["word"])
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(docs) > 100
    for r in docs:
        assert got.get(r["doc_id"], []) == tokens(r["text"] or "", {"Mr.", "etc."}), r["doc_id"]


def some_forest(rng, tags):
    def grow(depth):
        if depth == 0 or rng.random() < 0.2:
            p = np.array([rng.random() + 0.01 for _ in range(tags)])
            return [("leaf", rng.random() * 9 + 1, p / p.sum())]
        return [("inner", rng.randrange(2), rng.randrange(tags)), *grow(depth - 1), *grow(depth - 1)]

    return Forest([Forest.from_preorder(grow(3))])


def score(path, forest, prior, sent):
    state, total = (sent, sent), 0.0
    for tag, p, _ in path:
        total += log(p) + log(forest.predict(state)[tag]) - log(prior[tag])
        state = (state[1], tag)
    return total


@pytest.mark.parametrize("seed", range(40))
def test_decoder_finds_the_best_of_all_paths(seed):
    rng = random.Random(seed)
    tags = rng.randrange(2, 5)
    forest = some_forest(rng, tags)
    prior = forest.marginal()
    words = [[(t, rng.random() + 0.001, None) for t in rng.sample(range(tags), rng.randrange(1, tags + 1))] for _ in range(rng.randrange(1, 6))]
    kept = [[c for c in w if c[1] >= 0.05 * max(x[1] for x in w)] for w in words]
    got = viterbi(words, forest, 0, prior, 0.05)
    assert score(got, forest, prior, 0) == pytest.approx(max(score(p, forest, prior, 0) for p in itertools.product(*kept)), abs=1e-9)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_viterbi_tag_over_whole_documents(spark):
    model = registry.sample_model()
    n, prior = len(model.tags), model.forest.marginal()
    step = np.log([[model.forest.predict((a, b)) for b in range(n)] for a in range(n)]) - np.log(prior)
    got = {}
    for r in registry.QUERIES["viterbi_tag"](spark, DATA).orderBy("doc_id", "position").collect():
        got.setdefault(r["doc_id"], []).append(r)
    for doc in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        rows, raw, at = got.get(doc["doc_id"], []), (doc["text"] or "").encode(), 0
        assert [r["word"] for r in rows] == tokens(doc["text"] or "", {"Mr.", "etc."})
        table, state, own = np.full((n, n), -np.inf), (0, 0), 0.0
        table[0, 0] = 0.0
        for r in rows:
            cands = {t: p for t, p, _ in model.candidates(r["word"])}
            floor = max(cands.values()) * model.threshold
            chance = np.array([log(cands[t]) if cands.get(t, 0) >= floor and cands.get(t, 0) > 0 else -np.inf for t in range(n)])
            table = (table[:, :, None] + step).max(axis=0) + chance
            tag = model.ids[r["pos"]]
            own, state = own + chance[tag] + step[state][tag], (state[1], tag)
            if r["byte_end"] > r["byte_start"]:
                assert raw[r["byte_start"] : r["byte_end"]].decode() == r["word"] and r["byte_start"] >= at
                at = r["byte_end"]
        assert not rows or own == pytest.approx(table.max(), rel=1e-9)


def test_lines_in_the_order_of_a_language(spark):
    lines = spark.createDataFrame([(k, 0, "", "x", w) for k, w in enumerate(["zebra", "Äpfel", "apfel", "épée", "Zoo"])], "doc_id long, position int, left string, hit string, right string")
    assert [r["right"] for r in sort_lines(lines, "right1").collect()] == ["apfel", "zebra", "Zoo", "Äpfel", "épée"]
    assert [r["right"] for r in sort_lines(lines, "right1", collation="UNICODE").collect()] == ["apfel", "Äpfel", "épée", "zebra", "Zoo"]
