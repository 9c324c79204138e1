"""Schemas, layers and request defaults."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Literal

from pyspark.sql import types as T

Layer = Literal["word", "lemma", "pos"]
LAYERS: tuple[str, ...] = ("word", "lemma", "pos")

DEFAULT_CONTEXT = 7
DEFAULT_LIMIT = 50
COLLOCATE_HITS = 5000
MAX_WINDOW = 30
MAX_COLLOCATES = 200

TOKEN = T.StructType(
    [
        T.StructField("word", T.StringType()),
        T.StructField("lemma", T.StringType()),
        T.StructField("pos", T.StringType()),
        T.StructField("byte_start", T.IntegerType()),
        T.StructField("byte_end", T.IntegerType()),
    ]
)
DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("text", T.StringType())])
CORPUS = T.StructType([*DOCUMENT.fields, T.StructField("annotated", T.BooleanType()), T.StructField("tokens", T.ArrayType(TOKEN))])


@dataclass(frozen=True)
class KwicRequest:
    """A concordance request; each with_… call gives a changed copy."""

    term: str
    layer: str = "word"
    context: int = DEFAULT_CONTEXT
    limit: int | None = DEFAULT_LIMIT

    def with_layer(self, layer: str) -> KwicRequest:
        return KwicRequest(self.term, check_layer(layer), self.context, self.limit)

    def with_context(self, context: int) -> KwicRequest:
        return KwicRequest(self.term, self.layer, context, self.limit)

    def with_limit(self, limit: int | None) -> KwicRequest:
        return KwicRequest(self.term, self.layer, self.context, limit)

    def interactive(self) -> KwicRequest:
        """The desktop client's clamps: context 0 becomes 7, the limit is at least 1."""
        return KwicRequest(self.term, self.layer, self.context or DEFAULT_CONTEXT, max(1, self.limit or DEFAULT_LIMIT))


@dataclass(frozen=True)
class CorpusMeta:
    """What is known of a stored corpus."""

    id: str
    name: str
    index_path: str
    kind: str = "text"
    source_path: str = ""
    annotated: bool = False
    doc_count: int = 0
    token_count: int = 0
    types: int = 0
    avg_doc_len: int = 0
    built_at: str = ""
    build_ms: int = 0
    languages: list[str] = field(default_factory=list)
    tokeniser: str = "unicode-words"
    annotator: str | None = None
    size_on_disk: int = 0
    tagger_id: str | None = None


def check_layer(layer: str) -> str:
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer!r}; one of {', '.join(LAYERS)}")
    return layer
