"""How far one tagging differs from another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tagger_diff(oracle: DataFrame, subject: DataFrame) -> DataFrame:
    """Tokens of both at equal (doc_id, position), with the kind of difference: match, word, pos or lemma."""
    a = oracle.select("doc_id", "position", *[F.col(c).alias(f"oracle_{c}") for c in ("word", "pos", "lemma")])
    b = subject.select("doc_id", "position", *[F.col(c).alias(f"subject_{c}") for c in ("word", "pos", "lemma")])
    return _kinds(a.join(b, ["doc_id", "position"]))


def same_text_diff(docs: DataFrame, cut: Callable[[DataFrame], DataFrame], oracle: Callable[[DataFrame], DataFrame], subject: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """tagger_diff of two taggings of the same documents: both tag the same rows, so no token is shuffled.

    Tokens have a (doc_id, position) of their own only where the doc_id is its document's alone;
    documents that share one are few and joined as tagger_diff does, and those without one meet nothing.
    """
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("doc_id")
    some = bool(repeated.where(F.col("doc_id").isNotNull()).head(1))
    alone = (docs.join(repeated, "doc_id", "left_anti") if some else docs).where(F.col("doc_id").isNotNull())
    first = oracle(cut(alone)).withColumnsRenamed({"pos": "oracle_pos", "lemma": "oracle_lemma"})
    both = subject(first).withColumnsRenamed({"pos": "subject_pos", "lemma": "subject_lemma"}).withColumns({"oracle_word": F.col("word"), "subject_word": F.col("word")})
    out = _kinds(both.select("doc_id", "position", *[f"{side}_{c}" for side in ("oracle", "subject") for c in ("word", "pos", "lemma")]))
    if some:
        shared = docs.join(repeated, "doc_id", "left_semi")
        out = out.unionByName(tagger_diff(oracle(cut(shared)), subject(cut(shared))))
    return out


def _kinds(pairs: DataFrame) -> DataFrame:
    differ = [~F.col(f"oracle_{c}").eqNullSafe(F.col(f"subject_{c}")) for c in ("word", "pos", "lemma")]
    kind = F.when(differ[0], "word").when(differ[1], "pos").when(differ[2], "lemma").otherwise("match")
    return pairs.withColumn("kind", kind)


def accuracy(diff: DataFrame) -> DataFrame:
    """One row of counts; pos_accuracy leaves differing words out and is NaN where nothing is left."""
    counts = diff.agg(
        F.count(F.lit(1)).alias("compared"),
        *[F.count_if(F.col("kind") == k).alias(n) for k, n in (("match", "matches"), ("word", "word_errors"), ("pos", "pos_errors"), ("lemma", "lemma_errors"))],
    )
    good, all_ = F.col("matches") + F.col("lemma_errors"), F.col("matches") + F.col("lemma_errors") + F.col("pos_errors")
    return counts.withColumn("pos_accuracy", F.when(all_ == 0, F.lit(float("nan"))).otherwise(good / F.greatest(all_, F.lit(1))))
