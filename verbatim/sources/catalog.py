"""Stored corpora: places, names, metadata files and their list."""

from __future__ import annotations

import json
import os
import re
import tempfile
import time
import uuid
from dataclasses import fields
from pathlib import Path

from pyspark.sql import SparkSession

from ..schema import CorpusMeta

SCHEMA_VERSION = 1
ROOT_VARIABLE = "VERBATIM_DATA_ROOT"


def data_root() -> Path:
    """The variable's value as it stands if it isn't empty, else a folder in the user's home."""
    given = os.environ.get(ROOT_VARIABLE, "")
    return Path(given) if given else Path.home() / ".local" / "share" / "verbatim"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path that driver and executors share: below spark.checkpoint.dir, else, in local mode alone, a temporary folder."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set")
        top = tempfile.mkdtemp(prefix="verbatim-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def corpora_root() -> Path:
    return data_root() / "corpora"


def corpus_dir(slug: str) -> Path:
    return corpora_root() / slug


def index_path(slug: str) -> Path:
    return corpus_dir(slug) / "index"


def metadata_path(slug: str) -> Path:
    return corpus_dir(slug) / "metadata.json"


def slugify(name: str) -> str:
    """As functions.words.slug, for one name: ASCII letters only are lower-cased."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), name)
    kept = re.sub(r"[^a-z0-9_-]+", "-", re.sub(r"^[^a-z0-9_-]+", "", lowered))
    return kept.rstrip("-") or "corpus"


def unique_slug(base: str) -> str:
    for slug in [base, *(f"{base}-{n}" for n in range(2, 10_000))]:
        if not corpus_dir(slug).exists():
            return slug
    raise ValueError(f"no free name for {base!r}")


def dir_size(path: str | Path) -> int | None:
    """Bytes of all files below; None if there is no such folder."""
    top = Path(path)
    if not top.is_dir():
        return None
    return sum(p.stat().st_size for p in top.rglob("*") if p.is_file())


def stamp() -> str:
    return f"unix:{int(time.time())}"


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def write_metadata(path: str | Path, meta: CorpusMeta) -> None:
    """A versioned, indented JSON file; an annotator or tagger that is null is left out."""
    body = {_camel(f.name): getattr(meta, f.name) for f in fields(meta) if not (f.name in {"annotator", "tagger_id"} and getattr(meta, f.name) is None)}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps({"schemaVersion": SCHEMA_VERSION, "corpus": body}, indent=2, ensure_ascii=False))


def read_metadata(path: str | Path) -> CorpusMeta:
    body = json.loads(Path(path).read_text())
    if body.get("schemaVersion") != SCHEMA_VERSION:
        raise ValueError(f"metadata version {body.get('schemaVersion')} is not {SCHEMA_VERSION}")
    known = {_camel(f.name): f.name for f in fields(CorpusMeta)}
    return CorpusMeta(**{known[k]: v for k, v in body["corpus"].items() if k in known})


def list_corpora() -> list[CorpusMeta]:
    """All that can be read, by lower-cased name; others are passed over with a warning."""
    found = []
    for path in sorted(corpora_root().glob("*/metadata.json")):
        try:
            found.append(read_metadata(path))
        except (OSError, ValueError, KeyError, TypeError) as e:
            print(f"warning: {path}: {e}")
    return sorted(found, key=lambda m: m.name.lower())


def merge_lists(saved: list[CorpusMeta], others: list[CorpusMeta]) -> list[CorpusMeta]:
    """Saved corpora, then those others whose id isn't taken."""
    taken = {m.id for m in saved}
    return [*saved, *(m for m in others if m.id not in taken)]
