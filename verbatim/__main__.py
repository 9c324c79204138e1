"""Command line: index, kwic, collocates, frequency, list."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .functions.words import LANGUAGES, duration
from .operators.corpus import Corpus
from .schema import DEFAULT_CONTEXT, DEFAULT_LIMIT, LAYERS
from .sources import catalog
from .sources.text import read_text_dir


def check_language(code: str) -> str:
    if code not in LANGUAGES:
        raise SystemExit(f"unknown language {code!r}; one of {', '.join(sorted(LANGUAGES))}")
    return code


def format_lines(rows: list) -> list[str]:
    """File name in 20 columns, left contexts set flush right, the hit between them."""
    widest = max((len(r["left"]) for r in rows), default=0)
    return [f"{r['path'].rpartition('/')[2][:20]:<20}  {r['left'].rjust(widest)}  [{r['hit']}]  {r['right']}" for r in rows]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="verbatim", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)
    index = verbs.add_parser("index", help="tokenise a folder of .txt files and store it")
    index.add_argument("input")
    index.add_argument("--name", help="the folder's name if left out")
    index.add_argument("--out", help="a path of its own instead of the data root")
    index.add_argument("--language", default="en", type=check_language)
    for verb in ("kwic", "collocates", "frequency"):
        p = verbs.add_parser(verb)
        p.add_argument("corpus", help="a stored corpus's name or a path")
        if verb != "frequency":
            p.add_argument("term")
        p.add_argument("--layer", default="word", choices=LAYERS)
        p.add_argument("--limit", type=int, default=DEFAULT_LIMIT)
        if verb == "kwic":
            p.add_argument("--context", type=int, default=DEFAULT_CONTEXT)
        if verb == "collocates":
            p.add_argument("--left", type=int, default=5)
            p.add_argument("--right", type=int, default=5)
    verbs.add_parser("list")
    return top


def open_corpus(spark: SparkSession, name: str) -> Corpus:
    return Corpus.named(spark, name) if catalog.metadata_path(name).exists() else Corpus.open(spark, name)


def main(argv: list[str] | None = None) -> list[str]:
    args = parser().parse_args(argv)
    if args.verb == "list":
        return [f"{m.id:<24} {m.doc_count:>10,} documents  {m.name}" for m in catalog.list_corpora()]
    spark = SparkSession.builder.appName("verbatim").getOrCreate()
    started = time.time()
    if args.verb == "index":
        docs = read_text_dir(spark, args.input)
        if args.out:
            Corpus.build(docs, args.out)
            where = args.out
        else:
            where = Corpus.create(docs, args.name or args.input.rstrip("/").rpartition("/")[2], args.input, languages=(args.language,)).meta.id
        return [f"indexed {where} in {duration((time.time() - started) * 1000)}"]
    corpus = open_corpus(spark, args.corpus)
    if args.verb == "kwic":
        rows = corpus.kwic(args.term, args.layer, args.context, args.limit).orderBy("doc_id", "position").collect()
        return [*format_lines(rows), f"{len(rows)} hit(s) in {duration((time.time() - started) * 1000)}"]
    if args.verb == "collocates":
        rows = corpus.collocates(args.term, args.layer, args.left, args.right, args.limit).collect()
        return [f"{r['word']:<24} {r['left_count']:>6} {r['right_count']:>6} {r['total']:>6}" for r in rows]
    rows = corpus.frequency(args.layer, args.limit).collect()
    return [f"{r[args.layer]:<24} {r['count']:>8} {r['pct']:>8.4f}" for r in rows]


if __name__ == "__main__":
    print("\n".join(main()))
