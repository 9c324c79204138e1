"""SQL table functions over a corpus view; Catalyst inlines them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..schema import LAYERS

_TRIM = r"lower(regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', ''))"


def _hits(layer: str) -> str:
    """Positions at which a layer has the term; tags by the letter, the others whatever their case."""
    same = "t = term" if layer == "pos" else "lower(t) = lower(term)"
    return f"filter(transform(tokens.{layer}, (t, i) -> if({same}, i, -1)), i -> i >= 0)"


def register(corpus: DataFrame, view: str = "corpus") -> None:
    """Over the view: kwic(term, context), frequency(), document_hits(term), collocates(term, left, right),
    dispersion(term), density(term, buckets); kwic_lemma and kwic_pos where the tokens have those layers.
    """
    spark = corpus.sparkSession
    corpus.createOrReplaceTempView(view)
    layers = [f.name for f in corpus.schema["tokens"].dataType.elementType.fields if f.name in LAYERS]

    def put(name: str, arguments: str, columns: str, body: str) -> None:
        spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {view}_{name}")
        spark.sql(f"CREATE TEMPORARY FUNCTION {view}_{name}({arguments}) RETURNS TABLE({columns}) RETURN {body}")

    for layer in layers:
        put(
            "kwic" if layer == "word" else f"kwic_{layer}",
            "term STRING, context INT",
            "doc_id BIGINT, path STRING, position INT, left STRING, hit STRING, right STRING",
            "SELECT doc_id, path, x.p, x.l, x.h, x.r FROM (SELECT doc_id, path, explode_outer(transform(ps, p -> named_struct('p', p, "
            "'l', array_join(slice(w, greatest(p - context, 0) + 1, least(p, context)), ' '), 'h', get(w, p), 'r', array_join(slice(w, p + 2, context), ' ')))) AS x "
            f"FROM (SELECT doc_id, path, tokens.word AS w, {_hits(layer)} AS ps FROM {view})) WHERE x IS NOT NULL",
        )
    put("frequency", "", "word STRING, n BIGINT", f"SELECT lower(t), count(*) FROM (SELECT explode_outer(tokens.word) AS t FROM {view}) WHERE t IS NOT NULL GROUP BY 1")
    put(
        "document_hits",
        "term STRING",
        "doc_id BIGINT, hits BIGINT, per_million DOUBLE",
        f"SELECT doc_id, h, 1e6 * h / n FROM (SELECT doc_id, cast(size({_hits('word')}) AS BIGINT) AS h, size(tokens) AS n FROM {view}) WHERE h > 0",
    )
    reach = "greatest(left_window, right_window, 1)"
    shaped = lambda x: f"filter(transform({x}, w -> {_TRIM}), w -> octet_length(w) >= 2 AND NOT w RLIKE '^[0-9]+$')"
    put(
        "collocates",
        "term STRING, left_window INT, right_window INT",
        "word STRING, left_count BIGINT, right_count BIGINT, total BIGINT",
        "SELECT x.w, count_if(x.s = 'l'), count_if(x.s = 'r'), count(*) FROM (SELECT explode(concat("
        "transform(slice(l, greatest(size(l) - left_window, 0) + 1, left_window), w -> named_struct('s', 'l', 'w', w)), "
        "transform(slice(r, 1, right_window), w -> named_struct('s', 'r', 'w', w)))) AS x FROM (SELECT "
        f"{shaped('y.l')} AS l, {shaped('y.r')} AS r FROM (SELECT explode_outer(transform(ps, p -> named_struct("
        f"'l', slice(a, greatest(p - {reach}, 0) + 1, least(p, {reach})), 'r', slice(a, p + 2, {reach})))) AS y "
        f"FROM (SELECT tokens.word AS a, {_hits('word')} AS ps FROM {view})) WHERE y IS NOT NULL)) GROUP BY 1",
    )
    places = f"SELECT doc_id, size(tokens) AS n, explode_outer({_hits('word')}) AS p FROM {view}"
    put("dispersion", "term STRING", "doc_id BIGINT, mark INT, hits BIGINT", f"SELECT doc_id, cast(floor(p * 100 / n) AS INT), count(*) FROM ({places}) WHERE p IS NOT NULL GROUP BY 1, 2")
    put(
        "density",
        "term STRING, buckets INT",
        "bucket INT, hits BIGINT",
        f"WITH c AS (SELECT p, count(*) AS n FROM ({places}) WHERE p IS NOT NULL GROUP BY p), m AS (SELECT greatest(coalesce(max(p), 0), 1) AS top FROM c), "
        "b AS (SELECT least(buckets - 1, cast(floor(p * buckets / top) AS INT)) AS k, sum(n) AS n FROM c, m GROUP BY 1) "
        "SELECT e.k, coalesce(b.n, 0) FROM (SELECT explode(sequence(0, buckets - 1)) AS k) e LEFT JOIN b ON e.k = b.k",
    )
