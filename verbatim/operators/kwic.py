"""Keyword in context, orders of its lines, hit density and dispersion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_CONTEXT, KwicRequest, check_layer

LINE = ("doc_id", "path", "position", "left", "hit", "right")


def layer_matches(token: Column, term: str, layer: str) -> Column:
    """The only predicate: equality, case-insensitive on words and lemmas, exact on tags; an empty term matches nothing."""
    check_layer(layer)
    if not term:
        return F.lit(False)
    return token[layer] == term if layer == "pos" else F.lower(token[layer]) == term.lower()


def hit_positions(corpus: DataFrame, term: str, layer: str = "word") -> Column:
    """Positions of the matches, from the layer's own column of the tokens alone."""
    check_layer(layer)
    value = F.col(f"tokens.{layer}")
    if not term:
        return F.expr("cast(array() as array<int>)")
    if layer == "pos":
        at = F.transform(value, lambda t, i: F.when(t == term, i).otherwise(-1))
    else:
        at = F.transform(value, lambda t, i: F.when(F.lower(t) == term.lower(), i).otherwise(-1))
    return F.filter(at, lambda i: i >= 0)


def at_hits(corpus: DataFrame, term: str, layer: str, shape: Callable[[Column, Column], Column], *more: str, first: int | None = None) -> DataFrame:
    """One row a hit: doc_id, further columns, and `x`, the struct that `shape` makes of the document's words and the position.

    The structs are made inside the document and then exploded: beside an exploded position Spark would
    copy all of the document's words for each hit. Only the `first` hits of a document are taken, if given.
    """
    at = hit_positions(corpus, term, layer)
    found = corpus.select("doc_id", *more, F.col("tokens.word").alias("__w"), (at if first is None else F.slice(at, 1, first)).alias("__p"))
    rows = found.select("doc_id", *more, F.explode_outer(F.transform("__p", lambda p: shape(F.col("__w"), p))).alias("x"))
    return rows.where(F.col("x").isNotNull())


def words_before(words: Column, position: Column, n: int) -> Column:
    return F.slice(words, F.greatest(position - n, F.lit(0)) + 1, F.least(position, F.lit(n)))


def words_behind(words: Column, position: Column, n: int) -> Column:
    return F.slice(words, position + 2, F.lit(n))


def kwic(corpus: DataFrame, term: str, layer: str = "word", context: int = DEFAULT_CONTEXT, limit: int | None = None) -> DataFrame:
    """One line a hit: doc_id, path, position, left, hit, right.

    A narrow plan: positions are filtered and lines made inside each document's token array, the
    contexts being slices of it that end with the document, and then exploded. Documents without hits go
    after the explode, as a filter before it would be pushed down and tokenise the text a second
    time. With a limit the first hits by (doc_id, position) stay, by a top-k on each task.
    """
    if context < 0:
        raise ValueError("context is negative")

    def line(words: Column, p: Column) -> Column:
        left, right = (F.array_join(f(words, p, context), " ") for f in (words_before, words_behind))
        return F.struct(p.alias("position"), left.alias("left"), F.get(words, p).alias("hit"), right.alias("right"))

    lines = at_hits(corpus, term, layer, line, "path", first=limit).select("doc_id", "path", "x.position", "x.left", "x.hit", "x.right")
    return lines if limit is None else lines.orderBy("doc_id", "position").limit(limit)


def run(corpus: DataFrame, request: KwicRequest) -> DataFrame:
    return kwic(corpus, request.term, request.layer, request.context, request.limit)


def kwic_by_windows(tokens: DataFrame, term: str, context: int = DEFAULT_CONTEXT) -> DataFrame:
    """The same lines from a table of tokens (doc_id, position, word), by window frames; to cross-check kwic."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("position")
    return (
        tokens.withColumn("left", F.array_join(F.collect_list("word").over(w.rowsBetween(-context, -1)) if context else F.array(), " "))
        .withColumn("right", F.array_join(F.collect_list("word").over(w.rowsBetween(1, context)) if context else F.array(), " "))
        .where(F.lower("word") == term.lower())
        .select("doc_id", "position", "left", F.col("word").alias("hit"), "right")
    )


def sort_lines(lines: DataFrame, mode: str = "right1", descending: bool = False, collation: str | None = None) -> DataFrame:
    """Orders lines by the last word of the left context, the first of the right one, or the document; descending reverses ties too.

    A collation, such as UNICODE or a locale's, orders words as that language does; without one code points decide.
    """
    if mode == "left1":
        key = F.lower(F.element_at(F.split(F.trim("left"), r"\s+"), -1))
    elif mode == "right1":
        key = F.lower(F.element_at(F.split(F.trim("right"), r"\s+"), 1))
    elif mode == "doc":
        key = F.col("doc_id").cast("string")
    else:
        raise ValueError(f"unknown order {mode!r}")
    order = [key if collation is None else F.collate(key, collation), F.col("doc_id"), F.col("position")]
    return lines.orderBy(*[x.desc() if descending else x.asc() for x in order])


def numbered(lines: DataFrame) -> DataFrame:
    """Adds `row`, the line's place from 1 by (doc_id, position). For lines under a limit, which one task holds."""
    return lines.select(F.expr("row_number() OVER (ORDER BY doc_id, position)").alias("row"), "*")


def truncated(n_hits: int, limit: int) -> bool:
    """As the interactive client says it: true also when there are exactly as many hits."""
    return n_hits == limit


def density(lines: DataFrame, buckets: int = 60) -> DataFrame:
    """Hits by bucket of their position, empty buckets included."""
    places = lines.groupBy("position").agg(F.count(F.lit(1)).alias("c"))  # used twice, exchanged once
    top = places.agg(F.greatest(F.coalesce(F.max("position"), F.lit(0)), F.lit(1)).alias("top"))
    counts = (
        places.crossJoin(F.broadcast(top))  # one row
        .groupBy(F.least(F.lit(buckets - 1), F.expr(f"cast(floor(position * {buckets} / top) as int)")).alias("bucket"))
        .agg(F.sum("c").alias("n"))
    )
    every = lines.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("hits"))


def dispersion(corpus: DataFrame, term: str, layer: str = "word", marks: int = 100) -> DataFrame:
    """Hits by document and hundredth of the document."""
    hits = corpus.select("doc_id", F.size("tokens").alias("__n"), F.explode_outer(hit_positions(corpus, term, layer)).alias("position"))
    return (
        hits.where(F.col("position").isNotNull())
        .groupBy("doc_id", F.expr(f"cast(floor(position * {marks} / __n) as int)").alias("mark"))
        .agg(F.count(F.lit(1)).alias("hits"))
    )
