import random

#: Rows that every operator over documents must take: nulls, empty, ties, repeated rows, long and odd texts.
EDGES = [
    (0, "the cat sat on the mat and looked at the dog for a while"),
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (None, "no id at all but words"),
    (4, "the cat sat on the mat and looked at the dog for a while"),
    (4, "the cat sat on the mat and looked at the dog for a while"),
    (5, "İI ß ﬁ 日本語 \U0001f600 é́ ½"),
    (6, "word " * 30_000),
    (7, "x" * 100_000),
    (8, "!!! ??? 123"),
    (-3, "a\0b \0 c"),
    (9, "a <|endoftext|> b<|startoftext|>"),
]
SCHEMA = "doc_id long, text string, size int, shard string, position double, row_number string, __tie int"


def edge_docs(spark):
    """The rows with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, 1, "s", 0.5, "r", 2) for d, t in EDGES], SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def some_texts(n, seed=1, words=400):
    """Texts of a small vocabulary with copies, near copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoé") for _ in range(rng.randrange(2, 9))) for _ in range(words)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    out = []
    for k in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            out.append(rng.choice(out))
        elif out and kind < 0.35:
            w = rng.choice(out).split(" ")
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 200)))
            out.append(text[: len(text) // 2] + passage + text[len(text) // 2 :] if kind > 0.85 else text)
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
