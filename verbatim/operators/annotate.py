"""Annotators: from texts to aligned word, lemma and tag layers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.english import EnglishTokenizer, align
from ..functions.words import with_spans
from ..schema import TOKEN
from .tagger import Model

#: Tokens that Python holds before it gives them to Spark; one text's come on top.
BATCH_TOKENS = 1 << 16
_ARROW = {"word": pa.string(), "lemma": pa.string(), "pos": pa.string(), "byte_start": pa.int32(), "byte_end": pa.int32()}


class Annotator(Protocol):
    id: str
    languages: tuple[str, ...]

    def annotate(self, docs: DataFrame) -> DataFrame:
        """Adds `tokens` and `annotated` to documents."""


class WordOnly:
    """Unicode words with null lemma and tag."""

    id, languages = "word-only", ("*",)

    def annotate(self, docs: DataFrame) -> DataFrame:
        return with_spans(docs).withColumn("annotated", F.lit(False))


class TreeAnnotator:
    """English tokens, tagged by a model that is broadcast once; memory goes by BATCH_TOKENS, not by Spark's batches."""

    id, languages = "tree-viterbi", ("en",)

    def __init__(self, model: Model, abbreviations: list[str] | None = None):
        self.model, self.tokenizer = model, EnglishTokenizer(abbreviations or ())

    def annotate(self, docs: DataFrame) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast((self.model, self.tokenizer))
        docs = docs.drop("tokens", "annotated")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from array_batches(batches, lambda text: _layers(*shared.value, text))

        added = [T.StructField("tokens", T.ArrayType(TOKEN)), T.StructField("annotated", T.BooleanType(), False)]
        return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))

    def tokens(self, docs: DataFrame) -> DataFrame:
        """The tokens alone, one row each: doc_id, position, word, pos, lemma, byte_start, byte_end."""
        shared = docs.sparkSession.sparkContext.broadcast((self.model, self.tokenizer))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from row_batches(batches, lambda text: _layers(*shared.value, text), ("word", "pos", "lemma", "byte_start", "byte_end"))

        return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, position int, word string, pos string, lemma string, byte_start int, byte_end int")


def _layers(model: Model, tokenizer: EnglishTokenizer, text: str) -> dict[str, list]:
    words = tokenizer.tokenize(text)
    tags, spans = model.tag(words), align(words, text)
    return {"word": words, "lemma": [x for _, x in tags], "pos": [t for t, _ in tags], "byte_start": [a for a, _ in spans], "byte_end": [b for _, b in spans]}


def row_batches(batches: Iterator[pa.RecordBatch], cut: Callable[[str], dict[str, list]], layers: tuple[str, ...], most: int = BATCH_TOKENS) -> Iterator[pa.RecordBatch]:
    """From doc_id, text to doc_id, position and the layers that `cut` gives, in batches of `most` tokens at most."""

    def batch(ids: list, positions: list, columns: dict[str, list]) -> pa.RecordBatch:
        arrays = [pa.array(ids, pa.int64()), pa.array(positions, pa.int32()), *[pa.array(columns[k], _ARROW[k]) for k in layers]]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "position", *layers])

    ids, positions, held = [], [], {k: [] for k in layers}
    for doc_id, text in chain.from_iterable(_texts(b, b.column("doc_id")) for b in batches):
        found = cut(text)
        n = len(found["word"])
        for at in range(0, n, most):
            if len(ids) + min(most, n - at) > most:
                yield batch(ids, positions, held)
                ids, positions, held = [], [], {k: [] for k in layers}
            here = range(at, min(at + most, n))
            ids += [doc_id] * len(here)
            positions += here
            for k in layers:
                held[k] += found[k][at : at + most] if n > most else found[k]
    if ids:
        yield batch(ids, positions, held)


def array_batches(batches: Iterator[pa.RecordBatch], cut: Callable[[str], dict[str, list]], most: int = BATCH_TOKENS) -> Iterator[pa.RecordBatch]:
    """Adds `tokens` and `annotated`; a batch ends with the text that brings its tokens to `most`."""
    layers = [f.name for f in TOKEN.fields]
    for batch in batches:
        first, ends, held = 0, [0], {k: [] for k in layers}
        for k, (_, text) in enumerate(_texts(batch, batch.column("text"))):
            found = cut(text)
            for layer in layers:
                held[layer] += found[layer]
            ends.append(len(held["word"]))
            if ends[-1] >= most or k + 1 == batch.num_rows:
                structs = pa.StructArray.from_arrays([pa.array(held[x], _ARROW[x]) for x in layers], layers)
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)
                part = batch.slice(first, k + 1 - first)
                yield pa.RecordBatch.from_arrays([*part.columns, tokens, pa.array([True] * part.num_rows)], [*part.schema.names, "tokens", "annotated"])
                first, ends, held = k + 1, [0], {x: [] for x in layers}


def _texts(batch: pa.RecordBatch, keys: pa.Array) -> Iterator[tuple]:
    """Key and text of each row, one at a time; a null text is empty."""
    return ((key.as_py(), text.as_py() or "") for key, text in zip(keys, batch.column("text"), strict=True))


def english_tokens(docs: DataFrame, abbreviations: list[str] | None = None) -> DataFrame:
    """doc_id, position, word by the English rules."""
    tokenizer = EnglishTokenizer(abbreviations or ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from row_batches(batches, lambda text: {"word": tokenizer.tokenize(text)}, ("word",))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, position int, word string")


def tag_by_lexicon(tokens: DataFrame, lexicon: DataFrame, bound: int = 64 << 20) -> DataFrame:
    """Lexicon-only tagging as two joins: the word itself, else the lower-cased form of a capitalised word.

    lexicon(word, tag_id, tag, prob, lemma); a word's likeliest tag wins, of equals the one with the
    largest tag_id. The best entries are broadcast where they are below `bound` bytes, else joined by key.
    """
    top = lexicon.groupBy("word").agg(F.max_by(F.struct("tag", "lemma"), F.struct("prob", "tag_id")).alias("x"))
    top = top.select("word", F.col("x.tag").alias("tag"), F.col("x.lemma").alias("lemma"))
    size = top.agg(F.coalesce(F.sum(F.octet_length("word") + 64), F.lit(0))).first()[0]
    small = F.broadcast if size <= bound else (lambda x: x)
    exact = small(top.select(F.col("word").alias("__a"), F.col("tag").alias("__at"), F.col("lemma").alias("__al")))
    lower = small(top.select(F.col("word").alias("__b"), F.col("tag").alias("__bt"), F.col("lemma").alias("__bl")))
    capital = F.col("word").rlike(r"^\p{Lu}")
    return (
        tokens.join(exact, F.col("word") == F.col("__a"), "left")
        .join(lower, capital & F.col("__a").isNull() & (F.lower("word") == F.col("__b")), "left")
        .withColumn("pos", F.coalesce("__at", "__bt"))
        .withColumn("lemma", F.when(F.col("__a").isNotNull(), F.col("__al")).otherwise(F.col("__bl")))
        .drop("__a", "__at", "__al", "__b", "__bt", "__bl")
    )


def tag_by_suffix(tokens: DataFrame, suffixes: DataFrame, longest: int = 6, default: str = "NN", bound: int = 64 << 20) -> DataFrame:
    """Longest known suffix of suffixes(suffix, tag) as equi-joins, one a length; tokens are not shuffled.

    Suffixes of `bound` bytes and more are joined by key, with each distinct word's endings.
    """
    n = F.length("suffix")
    known = suffixes.where((n >= 1) & (n <= longest)).groupBy("suffix").agg(F.struct(F.max("tag").alias("tag")).alias("__t"))
    sizes = {r["n"]: r["size"] for r in known.groupBy(n.alias("n")).agg(F.sum(F.octet_length("suffix") + 64).alias("size")).collect()}  # `longest` rows at most
    if sum(sizes.values()) <= bound:
        out, order = tokens.withColumn("__w", F.lower("word")), sorted(sizes, reverse=True)
        for k in order:
            part = known.where(n == k).select(F.col("suffix").alias(f"__s{k}"), F.col("__t").alias(f"__t{k}"))
            out = out.join(F.broadcast(part), F.right("__w", F.lit(k)) == F.col(f"__s{k}"), "left")
        found = F.coalesce(*[F.col(f"__t{k}") for k in order])["tag"] if order else F.lit(None)
        return out.withColumn("pos", F.coalesce(found, F.lit(default))).drop("__w", *[f"__{x}{k}" for x in "st" for k in order])
    w = tokens.select(F.lower("word").alias("__w")).distinct()
    endings = w.select("__w", F.explode(F.expr(f"transform(sequence(1, least(length(__w), {longest})), n -> right(__w, n))")).alias("suffix"))
    best = endings.join(known, "suffix").groupBy("__w").agg(F.max_by("__t", F.length("suffix")).alias("__t"))
    return tokens.join(best, F.lower("word") == F.col("__w"), "left").withColumn("pos", F.coalesce(F.col("__t.tag"), F.lit(default))).drop("__w", "__t")


def merge_layers(words: DataFrame, tags: DataFrame) -> DataFrame:
    """Aligns layers that come from different places by (doc_id, position)."""
    return words.join(tags, ["doc_id", "position"], "left")
