import json

import pytest

from verbatim.operators.annotate import WordOnly
from verbatim.operators.corpus import Corpus
from verbatim.schema import CorpusMeta
from verbatim.sources import catalog
from verbatim.sources.text import clean_tags, from_table, read_abbreviations, read_text_dir, read_text_store
from verbatim.streaming.ingest import append_stream, text_stream


@pytest.fixture
def root(tmp_path, monkeypatch):
    monkeypatch.setenv(catalog.ROOT_VARIABLE, str(tmp_path / "root"))
    return tmp_path


def test_text_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in {"b.txt": "two\nlines", "a b.txt": "one", "_x.txt": "hidden", "c.TXT": "no", "d.md": "no", "sub/e.txt": "é"}.items():
        (tmp_path / name).write_text(text)
    rows = read_text_dir(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["path"].rpartition("/")[2], r["text"]) for r in rows] == [(0, "_x.txt", "hidden"), (1, "a b.txt", "one"), (2, "b.txt", "two\nlines"), (3, "e.txt", "é")]
    store = read_text_store(spark, f"file://{tmp_path}").orderBy("doc_id").collect()
    assert [(r["doc_id"], r["path"].rpartition("/")[2]) for r in store] == [(0, "a b.txt"), (1, "b.txt"), (2, "e.txt")]
    (tmp_path / "f.txt").write_text("a \N{REPLACEMENT CHARACTER} that is meant")
    assert read_text_store(spark, f"file://{tmp_path}").where("doc_id = 2").first()["text"] == "a \N{REPLACEMENT CHARACTER} that is meant"
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception):
        read_text_store(spark, f"file://{tmp_path}").collect()
    with pytest.raises(Exception):
        read_text_dir(spark, str(tmp_path)).collect()
    with pytest.raises(FileNotFoundError):
        read_text_dir(spark, str(tmp_path / "none"))


def test_build_append_open(spark, root):
    docs = from_table(spark.createDataFrame([(0, "the cat"), (1, "the dog")], "doc_id long, text string"))
    phases = []
    corpus = Corpus.create(docs, "My Corpus", progress=lambda p, ms: phases.append(p))
    assert phases == ["reading", "indexing", "committing", "done"]
    assert corpus.kwic("the").count() == 2
    meta = catalog.read_metadata(catalog.metadata_path("my-corpus"))
    assert (meta.name, meta.doc_count, meta.token_count, meta.avg_doc_len, meta.annotated) == ("My Corpus", 2, 2, 7, False)
    assert meta.size_on_disk > 0
    again = corpus.append(docs, meta.index_path)
    assert again.kwic("the").count() == 4
    assert Corpus.named(spark, "my-corpus").meta == meta
    second = Corpus.create(docs, "My corpus", annotator=WordOnly())
    assert second.meta.id == "my-corpus-2"
    assert [m.id for m in catalog.list_corpora()] == ["my-corpus", "my-corpus-2"]
    with pytest.raises(ValueError):
        Corpus.create(docs.where("false"), "empty")
    with pytest.raises(Exception):
        Corpus.open(spark, str(root / "missing"))
    with pytest.raises(ValueError):
        Corpus(docs)
    corpus.export(corpus.kwic("the"), str(root / "out"), "json")
    assert spark.read.json(str(root / "out")).count() == 2


def test_metadata_versions_and_sizes(root):
    path = catalog.metadata_path("x")
    catalog.write_metadata(path, CorpusMeta("x", "X", "/i"))
    body = json.loads(path.read_text())
    assert body["schemaVersion"] == 1 and "annotator" not in body["corpus"] and body["corpus"]["indexPath"] == "/i"
    body["schemaVersion"] = 999
    path.write_text(json.dumps(body))
    with pytest.raises(ValueError):
        catalog.read_metadata(path)
    assert catalog.list_corpora() == []
    (root / "s" / "t").mkdir(parents=True)
    (root / "s" / "a").write_bytes(b"12345")
    (root / "s" / "t" / "b").write_bytes(b"123456")
    assert catalog.dir_size(root / "s") == 11 and catalog.dir_size(root / "none") is None
    catalog.corpus_dir("taken").mkdir(parents=True)
    assert catalog.unique_slug("taken") == "taken-2"
    a, b, c = (CorpusMeta(i, i, "") for i in "abc")
    assert [m.id for m in catalog.merge_lists([a, b], [b, c])] == ["a", "b", "c"]


def test_tag_lines_and_abbreviations(spark, tmp_path):
    rows = spark.createDataFrame([("a", "NN", "<unknown>"), ("b", None, "b"), ("c", "VB", "")], "word string, pos string, lemma string")
    assert [(r["word"], r["lemma"]) for r in clean_tags(rows).collect()] == [("a", None), ("c", None)]
    (tmp_path / "abb").write_text("# note\n\nMr.\n etc. \nU.S.\n")
    assert sorted(read_abbreviations(spark, str(tmp_path / "abb"))) == ["Mr.", "U.S.", "etc."]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("the cat")
    run = lambda: append_stream(text_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in" / "b.txt").write_text("the dog")
    run()
    assert Corpus.open(spark, str(tmp_path / "out")).kwic("the").count() == 2


def test_command_line(spark, root):
    from verbatim.__main__ import main

    (root / "texts").mkdir()
    (root / "texts" / "a.txt").write_text("the cat sat")
    (root / "texts" / "b.txt").write_text("see the dog")
    assert main(["index", str(root / "texts")])[0].startswith("indexed texts in")
    assert catalog.read_metadata(catalog.metadata_path("texts")).languages == ["en"]
    out = main(["kwic", "texts", "the", "--context", "1"])
    assert out[0] == "a.txt" + " " * 15 + "       [the]  cat" and out[1] == "b.txt" + " " * 15 + "  see  [the]  dog" and out[2].startswith("2 hit(s) in")
    assert main(["collocates", "texts", "the"])[0].split() == ["cat", "0", "1", "1"]
    assert main(["frequency", "texts", "--limit", "1"])[0].split()[:2] == ["the", "2"]
    assert main(["list"])[0].startswith("texts ")
    with pytest.raises(SystemExit):
        main(["index", str(root / "texts"), "--language", "xx"])
    with pytest.raises(Exception):
        main(["kwic", str(root / "nothing"), "the"])
