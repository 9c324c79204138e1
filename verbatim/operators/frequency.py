"""Frequency lists, hits a document, vocabulary and corpus figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kwic import hit_positions


def frequency(corpus: DataFrame, layer: str = "word", by: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Count and per cent of a layer's values, lower-cased but for tags, all together or by other columns."""
    by = by or []
    value = F.col("__t") if layer == "pos" else F.lower("__t")
    counts = (
        corpus.select(*by, F.explode_outer(f"tokens.{layer}").alias("__t"))
        .where(F.col("__t").isNotNull() & (F.col("__t") != ""))
        .groupBy(*by, value.alias(layer))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    if by:
        totals = corpus.groupBy(*by).agg(F.sum(F.size(F.filter(f"tokens.{layer}", lambda t: t.isNotNull() & (t != "")))).alias("__n"))
        out = counts.join(totals, by)
    else:
        out = counts.crossJoin(F.broadcast(counts.agg(F.sum("count").alias("__n"))))  # one row
    out = out.select(*by, layer, "count", (100.0 * F.col("count") / F.col("__n")).alias("pct"))
    return out if limit is None else out.orderBy(F.col("count").desc(), *by, layer).limit(limit)


def with_bars(listed: DataFrame) -> DataFrame:
    """Adds each count's share of the largest one."""
    return listed.crossJoin(F.broadcast(listed.agg(F.max("count").alias("__m")))).withColumn("bar", F.col("count") / F.col("__m")).drop("__m")


def by_document(corpus: DataFrame, term: str, layer: str = "word", top: int | None = 8) -> DataFrame:
    """Hits and hits a million tokens by document, most first."""
    found = (
        corpus.select("doc_id", "path", F.size(hit_positions(corpus, term, layer)).cast("long").alias("hits"), F.size("tokens").cast("long").alias("doc_tokens"))
        .where(F.col("hits") > 0)
        .withColumn("per_million", 1e6 * F.col("hits") / F.col("doc_tokens"))
    )
    return found if top is None else found.orderBy(F.col("per_million").desc(), "doc_id").limit(top)


def stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: documents, bytes, tokens as bytes / 6, bytes a document."""
    agg = docs.agg(F.count(F.lit(1)).alias("doc_count"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("byte_count"))
    return agg.select(
        "doc_count", "byte_count",
        F.expr("byte_count div 6").alias("token_count_estimate"),
        F.expr("if(doc_count = 0, 0L, byte_count div greatest(doc_count, 1L))").alias("avg_doc_len"),
    )


def vocabulary(corpus: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: exact numbers of tokens and of distinct lower-cased words."""
    w = corpus.select(F.explode_outer("tokens.word").alias("w")).select(F.lower("w").alias("w"))
    return w.agg(F.count("w").alias("tokens"), (F.approx_count_distinct("w") if approximate else F.count_distinct("w")).alias("types"))


def words_per_second(tokens: Column, ms: Column) -> Column:
    return F.round(tokens / (ms / 1000))
