"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, small_batches

BUCKETS = 1 << 16
DIM = 16
GRAMS = (1, 2, 3, 4)
#: Labelled rows that the classifier is fitted on at most, and bytes of text after which no further one is taken: bounds on what the driver holds.
SAMPLE_ROWS, SAMPLE_BYTES = 4096, 64 << 20
EPOCHS = 4
RATE = 0.5
#: Share of the calibration targets that is spread over all languages.
SMOOTH = 0.02
UNKNOWN = "und"
CACHE_WORDS = 250_000
#: Characters of a text that are taken at a time, up to a white space.
PIECE = 1 << 20
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean"


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the byte n-grams of each word between "<" and ">", and how many each word has."""
    coded = [b"<" + w.encode() + b">" for w in words]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    raw = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(coded)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(raw))  # bytes of the word from here on
    found, whose = [], []
    h = np.zeros(len(raw), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = len(raw) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ raw[n - 1 : n - 1 + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in GRAMS:
            own = np.flatnonzero(left[:m] >= n)
            found.append(((h[own] + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64) % BUCKETS)
            whose.append(owner[own])
    buckets, owners = np.concatenate(found), np.concatenate(whose)
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.bincount(owners, minlength=len(coded))


def text_words(text: str) -> Iterator[list[str]]:
    """Lower-cased words, a piece of the text at a time."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE else text.find(" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].lower().split()
        at = end


def has_letter(text: str | None) -> bool:
    return bool(text) and (text[:64].isalpha() or any(c.isalpha() for c in text))


@dataclass
class LanguageModel:
    """`table` holds each bucket's embedding times the softmax's weights."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for text in texts:
        counts: dict[int, float] = {}
        for words in text_words(text):
            if words:
                b, n = np.unique(subwords(words)[0], return_counts=True)
                for k, v in zip(b.tolist(), n.tolist(), strict=True):
                    counts[k] = counts.get(k, 0) + v
        keys = np.fromiter(counts, np.int64, len(counts))
        weight = np.fromiter(counts.values(), float, len(counts))
        out.append((keys, weight / weight.sum() if len(weight) else weight))
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 7, epochs: int = EPOCHS, rate: float = RATE, margin: float = 0.8) -> LanguageModel:
    """Stochastic gradient descent, one document a step; every fifth document is kept for calibration.

    The temperature is the one with the least log loss on the kept documents. Scores under the
    threshold are rejected: `margin` of the lowest score of a kept document that is told right, one
    half at most.
    """
    names = sorted(set(langs))
    label = {x: i for i, x in enumerate(names)}
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    weights, bias = rng.normal(0, 1 / DIM, (DIM, len(names))), np.zeros(len(names))
    bags, y = _bags(texts), np.array([label[x] for x in langs], int)
    kept = [i for i in range(len(bags)) if i % 5 == 4 and len(bags[i][0])]
    used = np.array([i for i in range(len(bags)) if (i % 5 != 4 or len(bags) < 50) and len(bags[i][0])], int)
    total, step = max(1, epochs * len(used)), 0
    for _ in range(epochs):
        for i in rng.permutation(used):
            keys, share = bags[i]
            now = rate * (1 - step / total)
            step += 1
            rows = emb[keys]
            h = share @ rows
            p = _softmax(h @ weights + bias)
            p[y[i]] -= 1
            back = weights @ p
            weights -= now * np.outer(h, p)
            bias -= now * 0.1 * p
            emb[keys] = rows - now * len(keys) ** 0.5 * share[:, None] * back
    model = LanguageModel(names, emb @ weights, bias)
    if kept:
        logits = np.array([bags[i][1] @ model.table[bags[i][0]] + bias for i in kept])
        grid = np.geomspace(0.05, 20, 121)
        goal = np.full(logits.shape, SMOOTH / len(names))  # not quite certain, or separable languages would drive the temperature to nothing
        goal[np.arange(len(kept)), y[kept]] += 1 - SMOOTH
        loss = [-(goal * np.log(_softmax(logits / t) + 1e-12)).sum(1).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(logits / model.temperature)
        right = p.argmax(1) == y[kept]
        if right.any():
            model.threshold = float(min(0.5, margin * p.max(1)[right].min()))
    return model


class Scorer:
    """Number of subwords and sum of their table rows for each word, kept for the words seen last."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.index = defaultdict(count().__next__)  # a new word gets the next number
        self.sums = np.zeros((1024, len(self.model.langs) + 1))
        self.known = 0

    def _learn(self) -> None:
        new = list(islice(self.index, self.known, None))
        if not new:
            return
        if len(self.index) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros((max(len(self.sums), len(new)), self.sums.shape[1]))])
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            buckets, sizes = subwords(part)
            own = self.sums[self.known : self.known + len(part)]
            own[:, 0] = sizes
            own[:, 1:] = np.add.reduceat(self.model.table[buckets], np.cumsum(sizes) - sizes, axis=0)
            self.known += len(part)

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each whole text and its calibrated probability."""
        if len(self.index) > CACHE_WORDS:
            self._clear()
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        get, parts, owners = self.index.__getitem__, [], []
        for i, text in enumerate(texts):
            if self.model.langs and has_letter(text):
                for words in text_words(text):
                    if words:
                        parts.append(np.fromiter(map(get, words), np.int64, len(words)))
                        owners.append(i)
        self._learn()
        if not parts:
            return langs, scores
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        total = np.add.reduceat(self.sums[np.concatenate(parts)], np.cumsum(sizes) - sizes, axis=0)
        rows, first = np.unique(np.array(owners), return_index=True)
        total = np.add.reduceat(total, first, axis=0)
        p = _softmax((total[:, 1:] / np.maximum(total[:, :1], 1.0) + self.model.bias) / self.model.temperature)
        best = p.argmax(1)
        scores[rows] = p[np.arange(len(rows)), best]
        for i, k in zip(rows.tolist(), best.tolist(), strict=True):
            langs[i] = self.model.langs[k]
        return langs, scores


def learnable() -> str:
    """SQL of the rows that may be learned from: crc32 of the doc_id's digits, modulo 4, is not 2."""
    return "crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fits on labelled documents in the order of their doc_id's hash; only text and lang are read of them.

    At most `rows` documents, and no further one once those before it hold SAMPLE_BYTES of text.
    """
    labelled = docs.where("doc_id is not null and lang is not null and text is not null").where(learnable())
    keyed = labelled.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("__h"), "doc_id", "text", "lang")
    n = keyed.count()
    cut = (1 << 30) if n <= rows else int((1 << 30) * rows * 1.05 / n) + 1
    order = ["__h", "doc_id", "lang", F.length("text")]
    some = keyed.where(F.col("__h") < cut).orderBy(*order).limit(rows)
    size = F.octet_length("text").cast("long")
    some = some.withColumn("__before", F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - size)  # `rows` rows
    some = some.where(F.col("__before") < SAMPLE_BYTES).collect()
    own = [(r["text"], r["lang"]) for r in some if has_letter(r["text"])]
    if not own:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    return train([t for t, _ in own], [x for _, x in own])


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (0 to 1) and accepted (the score reaches the model's threshold).

    Defined results: null text or text without a letter is "und" with score 0 and not accepted, as is
    everything where there was nothing to learn from; a null doc_id is not held out; repeated rows get
    the same result each; an empty table gives an empty result; other columns are ignored.
    """
    model = model or fit(docs)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column("doc_id").to_pylist()
                out = [x is not None and zlib.crc32(str(x).encode()) % 4 == 2 for x in ids]
                langs, scores = scorer.score(part.column("text").to_pylist())
                good = [a != UNKNOWN and s >= scorer.model.threshold for a, s in zip(langs, scores.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out), pa.array(langs, pa.string()), pa.array(scores), pa.array(good, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, SCHEMA)


def keep_identified(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """The documents whose language is accepted, with all their columns, without a shuffle.

    Defined results: null texts and texts without a letter go, whatever their doc_id; repeated rows are
    judged alike; where there was nothing to learn from, all go; an empty table gives an empty result;
    names of other columns do not matter.
    """
    model = model or fit(docs)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def accepted(texts):
        import pandas as pd

        scorer = _scorer(shared)
        good: list[bool] = []
        batch = pa.RecordBatch.from_arrays([pa.array([t if isinstance(t, str) else None for t in texts], pa.string())], ["text"])
        for part in slices(batch, "text"):
            langs, scores = scorer.score(part.column("text").to_pylist())
            good += [a != UNKNOWN and s >= scorer.model.threshold for a, s in zip(langs, scores.tolist(), strict=True)]
        return pd.Series(good, dtype=bool)

    return docs.where(accepted(F.col("text")))


_kept: dict[int, Scorer] = {}


def _scorer(shared) -> Scorer:
    """One a worker process and model, so that words are looked up once."""
    key = hash(shared.value.table.tobytes()[:4096]) ^ len(shared.value.langs)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Scorer(shared.value)
    return _kept[key]
