"""A corpus on disk: build, append, open, and its queries as methods."""

from __future__ import annotations

import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..schema import COLLOCATE_HITS, CORPUS, DEFAULT_CONTEXT, CorpusMeta, KwicRequest
from ..sources import catalog
from . import collocates as _collocates
from . import frequency as _frequency
from . import kwic as _kwic
from .annotate import Annotator, WordOnly

Progress = Callable[[str, float], None]
_opened: dict[str, Corpus] = {}


class Corpus:
    """Documents with their token arrays; every query is a plain DataFrame."""

    def __init__(self, df: DataFrame, meta: CorpusMeta | None = None):
        missing = {f.name for f in CORPUS.fields} - set(df.columns)
        if missing:
            raise ValueError(f"not a corpus: no {', '.join(sorted(missing))}")
        self.df, self.meta = df, meta

    @classmethod
    def from_documents(cls, docs: DataFrame, annotator: Annotator | None = None) -> Corpus:
        return cls((annotator or WordOnly()).annotate(docs))

    @classmethod
    def build(cls, docs: DataFrame, path: str, annotator: Annotator | None = None, progress: Progress | None = None) -> Corpus:
        """Overwrites `path`. Phases: reading, annotating or indexing, committing, done or failed."""
        started = time.time()
        tell = progress or (lambda phase, ms: None)
        say = lambda phase: tell(phase, (time.time() - started) * 1000)
        try:
            say("reading")
            corpus = cls.from_documents(docs, annotator)
            say("annotating" if annotator else "indexing")
            corpus.df.write.mode("overwrite").parquet(path)
            say("committing")
            out = cls.open(docs.sparkSession, path)
            say("done")
        except Exception:
            say("failed")
            raise
        return out

    @classmethod
    def create(cls, docs: DataFrame, name: str, source: str = "", annotator: Annotator | None = None, progress: Progress | None = None, languages: tuple[str, ...] = ()) -> Corpus:
        """Builds under the data root, with a free name and a metadata file; an empty source is an error."""
        if docs.isEmpty():
            raise ValueError("no documents")
        started = time.time()
        slug = catalog.unique_slug(catalog.slugify(name))
        where = str(catalog.index_path(slug))
        corpus = cls.build(docs, where, annotator, progress)
        row = _frequency.stats(docs).first()
        corpus.meta = CorpusMeta(
            id=slug, name=name, index_path=where, source_path=source, annotated=annotator is not None, doc_count=row["doc_count"],
            token_count=row["token_count_estimate"], avg_doc_len=row["avg_doc_len"], built_at=catalog.stamp(),
            languages=list(languages), build_ms=int((time.time() - started) * 1000), annotator=annotator.id if annotator else None, size_on_disk=catalog.dir_size(where) or 0,
        )
        catalog.write_metadata(catalog.metadata_path(slug), corpus.meta)
        _opened[slug] = corpus
        return corpus

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Corpus:
        """Fails where there is no corpus or its schema lacks a column."""
        return cls(spark.read.parquet(path))

    @classmethod
    def named(cls, spark: SparkSession, slug: str) -> Corpus:
        """By name, opened once a process."""
        if slug not in _opened:
            meta = catalog.read_metadata(catalog.metadata_path(slug))
            _opened[slug] = cls(spark.read.parquet(meta.index_path), meta)
        return _opened[slug]

    def append(self, docs: DataFrame, path: str, annotator: Annotator | None = None) -> Corpus:
        """Adds documents in one commit; equal ids are not refused."""
        Corpus.from_documents(docs, annotator).df.select(*self.df.columns).write.mode("append").parquet(path)
        return Corpus.open(docs.sparkSession, path)

    def export(self, df: DataFrame, path: str, form: str = "csv") -> None:
        """Any result as CSV or JSON lines."""
        writer = df.write.mode("overwrite")
        if form == "csv":
            writer.option("header", True).csv(path)
        elif form == "json":
            writer.json(path)
        else:
            raise ValueError(f"unknown form {form!r}")

    def kwic(self, term: str, layer: str = "word", context: int = DEFAULT_CONTEXT, limit: int | None = None) -> DataFrame:
        return _kwic.kwic(self.df, term, layer, context, limit)

    def collocates(self, term: str, layer: str = "word", left: int = 5, right: int = 5, limit: int = 50, max_hits: int | None = COLLOCATE_HITS) -> DataFrame:
        """Over the first `max_hits` hits by (doc_id, position); None counts all."""
        return _collocates.collocates(self.df, term, layer, left, right, limit, max_hits)

    def run(self, request: KwicRequest) -> DataFrame:
        """A request as a client sends it: term, layer, context and limit are brought within the interactive bounds."""
        return _kwic.run(self.df, request.interactive())

    def frequency(self, layer: str = "word", limit: int | None = None) -> DataFrame:
        return _frequency.frequency(self.df, layer, limit=limit)

    def doc_frequency(self, term: str, layer: str = "word", top: int | None = 8) -> DataFrame:
        return _frequency.by_document(self.df, term, layer, top)

    def density(self, term: str, layer: str = "word", buckets: int = 60) -> DataFrame:
        return _kwic.density(self.kwic(term, layer), buckets)

    def dispersion(self, term: str, layer: str = "word") -> DataFrame:
        return _kwic.dispersion(self.df, term, layer)

    def register(self, view: str = "corpus") -> None:
        """The corpus and its queries in SQL."""
        from ..plans.sql import register

        register(self.df, view)


def exists(path: str) -> bool:
    return Path(path).exists()
