"""Words, byte spans and small text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import TOKEN

#: Words with their inner marks; the same text works in Java and in RE2.
WORD_RE = r"(?:[\p{L}\p{M}]+(?:['’‘.:·][\p{L}\p{M}]+)*|\p{Nd}+(?:[,;.'’‘]\p{Nd}+)*|_+)+"
ALNUM_RE = r"[\p{L}\p{N}]"

#: The marks around the body of a public-domain book file.
START_MARK = r"\*\*\*\s*START OF (?:THIS |THE )?PROJECT GUTENBERG[^*]*\*\*\*"
END_MARK = r"\*\*\*\s*END OF (?:THIS |THE )?PROJECT GUTENBERG"

#: The languages of the downloadable models.
LANGUAGES = {"en": "english", "fr": "french", "de": "german", "it": "italian", "es": "spanish", "nl": "dutch", "pt": "portuguese", "ru": "russian", "pl": "polish", "cs": "czech", "bg": "bulgarian"}


def words(text: Column | str) -> Column:
    """The words of a text in order, case kept."""
    found = F.regexp_extract_all(text if isinstance(text, Column) else F.col(text), F.lit(f"({WORD_RE})"), F.lit(1))
    return F.filter(found, lambda w: w.rlike(ALNUM_RE))


def with_spans(df: DataFrame, text: str = "text", out: str = "tokens", keep: list[str] | None = None) -> DataFrame:
    """Adds an array of (word, null lemma, null pos, byte_start, byte_end) to the columns `keep`, or to all.

    Gaps and words alternate, so a word's end is the running sum of their UTF-8 lengths. Built-in
    expressions have no running sum over an array that is linear, and are interpreted an element at a
    time inside arrays; so the sums are numpy's, over whole Arrow batches, without a shuffle.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c != out]
    groups = [F.regexp_extract_all(F.col(text), F.lit(f"(?s)(.*?)({WORD_RE})"), F.lit(n)).alias(c) for n, c in ((1, "__g"), (2, "__w"))]
    cut = df.select(*kept, *groups, F.col(text).rlike(r"[\p{M}_]").alias("__odd"))  # else each word has a letter or a number
    cut = cut.withColumn("__k", F.when(F.col("__odd"), F.transform("__w", lambda w: w.rlike(ALNUM_RE)))).drop("__odd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], spans(*[batch.column(c) for c in ("__g", "__w", "__k")])], [*kept, out])

    return cut.mapInArrow(run, T.StructType([*cut.select(*kept).schema.fields, T.StructField(out, T.ArrayType(TOKEN))]))


def spans(gaps: pa.ListArray, words: pa.ListArray, good: pa.ListArray) -> pa.ListArray:
    """Tokens of the words and the gaps before them; of lists with a `good` only words marked so."""
    counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    word = words.flatten()
    size = pc.binary_length(word).to_numpy(zero_copy_only=False)
    sums = np.concatenate([[0], np.cumsum(pc.binary_length(gaps.flatten()).to_numpy(zero_copy_only=False) + size.astype(np.int64))])
    ends = (sums[1:] - np.repeat(sums[firsts[:-1]], counts)).astype(np.int32)
    starts = ends - size.astype(np.int32)
    if good.null_count < len(good):
        chosen = np.ones(len(word), bool)
        chosen[np.repeat(good.is_valid().to_numpy(zero_copy_only=False), counts)] = good.flatten().to_numpy(zero_copy_only=False)
        firsts = np.concatenate([[0], np.cumsum(chosen)])[firsts]
        word, starts, ends = word.filter(pa.array(chosen)), starts[chosen], ends[chosen]
    none = pa.nulls(len(word), pa.string())
    structs = pa.StructArray.from_arrays([word, none, none, pa.array(starts), pa.array(ends)], [f.name for f in TOKEN.fields])
    return pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), structs, mask=words.is_null())


def each(df: DataFrame, array: Column | str, *keep: str) -> DataFrame:
    """One row an element: the kept columns, position, value.

    Rows without elements go after the explode: a filter before it, which Spark infers for a plain
    explode, would be pushed down with the whole tokenising, which would then run twice.
    """
    return df.select(*keep, F.posexplode_outer(array).alias("position", "value")).where(F.col("position").isNotNull())


def collocate_words(text: Column) -> Column:
    """White-space parts, trimmed of other than letters and numbers, lower-cased; without single bytes and plain numbers."""
    parts = F.transform(F.split(text, r"\s+"), lambda t: F.lower(F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    return F.filter(parts, is_collocate)


def is_collocate(word: Column) -> Column:
    return (F.octet_length(word) >= 2) & ~word.rlike("^[0-9]+$")


def trimmed_lower(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def slug(name: Column) -> Column:
    """ASCII letters, digits, "_" and "-" lower-cased; runs of others become one "-", never in front or at the end."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(name), r"^[^a-z0-9_-]+", ""), r"[^a-z0-9_-]+", "-")
    trimmed = F.regexp_replace(kept, "-+$", "")
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit("corpus"))


def strip_boilerplate(text: Column) -> Column:
    """The text between the first start marker and the first end marker behind it, trimmed."""
    begun = F.regexp_replace(text, f"(?is)^.*?{START_MARK}", "")
    ended = F.regexp_replace(begun, f"(?is){END_MARK}.*$", "")
    return F.regexp_replace(ended, r"^\s+|\s+$", "")


def pos_family(tag: Column) -> Column:
    return (
        F.when(tag.startswith("NN"), "noun")
        .when(tag.startswith("VB") | tag.startswith("MD"), "verb")
        .when(tag.startswith("JJ"), "adj")
        .when(tag.startswith("RB"), "adv")
        .otherwise("function")
    )


def preference(left: Column, right: Column) -> Column:
    """(R - L) / total, 0 where there is nothing."""
    total = left + right
    return F.when(total == 0, F.lit(0.0)).otherwise((right - left) / total)


def language_name(code: Column) -> Column:
    """Name of a language code; unknown codes fail."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code), F.raise_error(F.concat(F.lit("unknown language "), code)).cast("string"))


def duration(ms: float) -> str:
    return f"{ms * 1000:.0f} µs" if ms < 1 else f"{ms:.1f} ms" if ms < 1000 else f"{ms / 1000:.2f} s"


def build_time(ms: float) -> str:
    seconds = ms / 1000
    return f"{seconds:.1f} s" if seconds < 60 else f"{int(seconds // 60)}:{int(seconds % 60):02d}"


def thousands(n: int) -> str:
    return f"{n:,}"


def byte_size(n: int | None) -> str:
    if n is None:
        return "–"
    size, unit = float(n), "B"
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if size < 1024 or unit == "TB":
            break
        size /= 1024
    return f"{size:.0f} {unit}" if unit == "B" else f"{size:.1f} {unit}"
