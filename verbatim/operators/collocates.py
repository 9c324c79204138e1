"""Collocates: words near a node, counted by side, and how strongly they go with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import each, is_collocate, pos_family, preference, trimmed_lower
from ..schema import COLLOCATE_HITS, MAX_COLLOCATES, MAX_WINDOW
from .kwic import at_hits, words_before, words_behind


def hit_windows(corpus: DataFrame, term: str, layer: str = "word", left: int = 5, right: int = 5, max_hits: int | None = COLLOCATE_HITS) -> DataFrame:
    """One row a hit: doc_id, position and `near`, the (side, word) beside it, words as they stand; not all need be collocates.

    max(left, right, 1) words are taken on both sides, single bytes and numbers dropped, and only
    then is each side cut to its length, so the narrower side may reach further out. The wider side
    loses nothing by the cut, so there what is no collocate is left to be dropped later.
    """
    left, right = min(left, MAX_WINDOW), min(right, MAX_WINDOW)
    if left < 0 or right < 0 or left + right == 0:
        raise ValueError("both windows are empty")
    reach = max(left, right, 1)

    def kept(words, n, start):
        if n == reach:
            return words
        good = F.filter(words, lambda w: is_collocate(trimmed_lower(w)))
        return F.get(F.transform(F.array(good), lambda g: F.slice(g, start(g), F.lit(n))), F.lit(0))  # cut once

    def named(side, words):
        return F.transform(words, lambda w: F.struct(F.lit(side).alias("side"), w.alias("word")))

    def near(words, p):
        sides = []
        if left:
            sides.append(("l", kept(words_before(words, p, reach), left, lambda g: F.greatest(F.size(g) - left, F.lit(0)) + 1)))
        if right:
            sides.append(("r", kept(words_behind(words, p, reach), right, lambda g: F.lit(1))))
        return F.struct(p.alias("position"), F.concat(*[named(side, x) for side, x in sides]).alias("near"))

    hits = at_hits(corpus, term, layer, near, first=max_hits).select("doc_id", "x.position", "x.near")
    return hits if max_hits is None else hits.orderBy("doc_id", "position").limit(max_hits)  # a top-k on each task


def _words(hits: DataFrame) -> DataFrame:
    return each(hits, "near").select("value.side", "value.word")


def windows(corpus: DataFrame, term: str, layer: str = "word", left: int = 5, right: int = 5, max_hits: int | None = COLLOCATE_HITS) -> DataFrame:
    """The collocates beside each hit: side, word."""
    found = _words(hit_windows(corpus, term, layer, left, right, max_hits))
    return found.select("side", trimmed_lower(F.col("word")).alias("word")).where(is_collocate(F.col("word")))


def counted(corpus: DataFrame, term: str, layer: str = "word", left: int = 5, right: int = 5, max_hits: int | None = COLLOCATE_HITS) -> DataFrame:
    """word, left_count, right_count: words are counted as they stand, and then only the distinct ones are trimmed and lower-cased."""
    raw = (
        _words(hit_windows(corpus, term, layer, left, right, max_hits))
        .groupBy("word")
        .agg(F.count_if(F.col("side") == "l").alias("l"), F.count_if(F.col("side") == "r").alias("r"))
    )
    shaped = raw.select(trimmed_lower(F.col("word")).alias("word"), "l", "r").where(is_collocate(F.col("word")))
    return shaped.groupBy("word").agg(F.sum("l").alias("left_count"), F.sum("r").alias("right_count"))


def collocates(corpus: DataFrame, term: str, layer: str = "word", left: int = 5, right: int = 5, limit: int = 50, max_hits: int | None = COLLOCATE_HITS) -> DataFrame:
    """The most frequent collocates; equal totals by word. The three scores are the stand-in log2(total + 1)."""
    found = counted(corpus, term, layer, left, right, max_hits).withColumn("total", F.col("left_count") + F.col("right_count"))
    score = F.log2(F.col("total") + 1)
    return (
        found.select("word", F.lit("").alias("pos"), "left_count", "right_count", "total", score.alias("log_dice"), score.alias("mi"), score.alias("z"), F.lit(0).alias("dist"))
        .orderBy(F.col("total").desc(), F.col("word").asc())
        .limit(max(1, min(limit, MAX_COLLOCATES)))
    )


def summary(corpus: DataFrame, term: str, layer: str = "word", left: int = 5, right: int = 5, max_hits: int | None = COLLOCATE_HITS) -> DataFrame:
    """node_hits and window_tokens, before any cut to the most frequent; both of one pass over the hits."""
    hits = hit_windows(corpus, term, layer, left, right, max_hits)
    tokens = F.size(F.filter("near", lambda x: is_collocate(trimmed_lower(x["word"]))))
    return hits.agg(F.count(F.lit(1)).alias("node_hits"), F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("window_tokens"))


def scored(corpus: DataFrame, term: str, left: int = 5, right: int = 5, min_total: int = 2) -> DataFrame:
    """Published scores in place of the stand-in: logDice, MI and z over the corpus's own frequencies."""
    found = counted(corpus, term, "word", left, right, None).select("word", (F.col("left_count") + F.col("right_count")).alias("total")).where(F.col("total") >= min_total)
    raw = corpus.select(F.explode_outer("tokens.word").alias("w")).where(F.col("w").isNotNull()).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    freq = raw.groupBy(trimmed_lower(F.col("w")).alias("word")).agg(F.sum("n").alias("freq"))
    whole = freq.agg(F.sum("freq").alias("n"), F.coalesce(F.sum(F.when(F.col("word") == term.lower(), F.col("freq"))), F.lit(0)).alias("node"))
    x = found.join(freq, "word").crossJoin(F.broadcast(whole))  # one row
    expected = F.col("node") * F.col("freq") * (left + right) / F.col("n")
    return x.select(
        "word", "total", "freq",
        (14 + F.log2(2 * F.col("total") / (F.col("node") + F.col("freq")))).alias("log_dice"),
        F.log2(F.col("total") / expected).alias("mi"),
        ((F.col("total") - expected) / F.sqrt(expected)).alias("z"),
    )


def for_chart(found: DataFrame) -> DataFrame:
    """Adds side preference, family of the tag, and the radius of a bubble chart."""
    top = found.agg(F.max("total").alias("max_total"))
    return found.crossJoin(F.broadcast(top)).select(  # one row
        "*", preference(F.col("left_count"), F.col("right_count")).alias("preference"), pos_family(F.col("pos")).alias("family"),
        (4 + 12 * F.sqrt("total") / F.sqrt("max_total")).alias("radius"),
    )


def sort_table(found: DataFrame, column: str = "total", descending: bool = True) -> DataFrame:
    if column not in {"word", "pos", "left_count", "right_count", "total", "log_dice", "mi", "z"}:
        raise ValueError(f"unknown column {column!r}")
    return found.orderBy(F.col(column).desc() if descending else F.col(column).asc(), "word")
