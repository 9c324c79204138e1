import os
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from verbatim.llm import packing, simple8b, token_counts, token_files, tokens
from verbatim.llm.tokens import UnitEncoder

from .helpers import EDGES, edge_docs, empty_docs, frame, some_texts

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def plain(file, literal=False):
    t = Tokenizer.from_file(public_tokenizers.path(file))
    t.encode_special_tokens = literal
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("file", [BYTE, WORD])
def test_units_give_the_librarys_ids(file):
    rng, alphabet = random.Random(2), " \n\t'sdLL.,1aÉé́ 😀\0ß|-"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += ["a  b", " a", "a ", "\n", "a\n\nb", "a \nb", "it's 's", "<|endoftext|> x", "a<|endoftext|>b <|startoftext|> c", "<|ENDOFTEXT|>", "don't. \nX", "ªº ß, Ⅷ x.\nY"] + [t for _, t in EDGES if t] + some_texts(40)
    want = plain(file)
    got = UnitEncoder(file, most=200).encode(texts, 7)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*want(text), 7], repr(text[:80])


@pytest.mark.parametrize("n", [0, 1, 5, 255, 4096, 4097, 9000])
@pytest.mark.parametrize("top", [1, 2, 300, 60_000, 2**33, 2**63])
def test_simple8b_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n, dtype=np.uint64)
    ids[n // 3 : n // 2] = 0
    docs = np.zeros(2, simple8b.DOC)
    for block in (64, 4096):
        image = simple8b.write_image(docs, ids, block)
        table, back = simple8b.read_image(image)
        assert len(table) == 2 and (back == ids).all()
        for k in range(-(-n // block)):
            assert (simple8b.read_block(image, k) == ids[k * block : (k + 1) * block]).all()
    with pytest.raises(ValueError):
        simple8b.read_image(b"x" * 80)


def expected_tokens(rows, end):
    ids, out, start = plain(BYTE), [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = np.array([*ids(t), end], "<u4").tobytes()
        out.append((d, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    return out


def test_token_files(spark, tmp_path):
    texts = some_texts(60)
    rows = list(enumerate(texts))
    path = str(tmp_path / "files")
    token_files.write_token_files(frame(spark, texts), path, image_ids=500)
    got = [tuple(r) for r in token_files.read_token_files(spark, path).orderBy("doc_id").collect()]
    assert got == expected_tokens(rows, 2)


def test_reading_token_files_gives_back_the_encoders_units(spark, tmp_path):
    path = str(tmp_path / "tokens")
    docs = frame(spark, some_texts(60))

    def kept(batches):
        held = tokens.encoder.cache_info().currsize
        yield from (pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([held])], ["pid", "kept"]) for batch in batches if batch.num_rows)

    def workers():
        return {r.pid: r.kept for r in spark.range(400).repartition(8).mapInArrow(kept, "pid long, kept long").collect()}

    token_files.write_token_files(docs, path)
    before = workers()
    assert token_files.read_token_files(spark, path).count() == 60
    after = workers()
    assert [pid for pid, n in before.items() if n and after.get(pid) == 0]


def test_token_files_edges(spark):
    got = token_files.token_files(edge_docs(spark)).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((d is not None, d or 0, n, c) for d, _, n, c in expected_tokens(EDGES, 2))
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert token_files.token_files(empty_docs(spark)).count() == 0


def check_packs(rows, got, limit):
    ids = plain(WORD)
    whole = sorted(((d, [*ids(t), 1]) for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    assert sum(r["length"] for r in got) == sum(len(x) for _, x in whole)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= limit
    want = sorted((d is not None, d or 0, a, len(x[a : a + limit]), zlib.crc32(np.array(x[a : a + limit], "<u4").tobytes()), len(x)) for d, x in whole for a in range(0, len(x), limit))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    return len(by_sequence)


def test_packing(spark):
    texts = some_texts(300)
    got = packing.pack_documents(frame(spark, texts), limit=128).collect()
    n = check_packs(list(enumerate(texts)), got, 128)
    assert sum(r["length"] for r in got) / (128 * n) > 0.95
    check_packs(EDGES, packing.pack_documents(edge_docs(spark)).collect(), 2048)
    assert packing.pack_documents(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("histogram", [{}, {1: 5}, {2048: 3, 1: 2}, {5: 10**9, 700: 10**6, 1999: 3}, {k: k * 7919 % 97 + 1 for k in range(1, 2049)}])
def test_pack_histogram(histogram):
    placed, packs = packing.pack_histogram(histogram)
    for length, count in histogram.items():
        rank = 0
        for first, n, base, offset in placed[length].tolist():
            assert first == rank and base + n <= packs and offset + length <= 2048
            rank += n
        assert rank == count
    total = sum(k * v for k, v in histogram.items())
    assert packs <= 1.02 * total / 2048 + 2 or not total or {2048: 3, 1: 2} == histogram


def test_token_counts(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_IDS", 64)
    ids = plain(BYTE, literal=True)
    texts = [*some_texts(50), "", None, "word " * 500]
    got = token_counts.count_tokens(frame(spark, texts)).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {k: len(ids(t)) for k, t in enumerate(texts)}
    for file in {r["file_id"] for r in got}:
        own = sorted((r["doc_no"], r["start"], r["n_tokens"]) for r in got if r["file_id"] == file)
        assert [d for d, _, _ in own] == list(range(len(own)))
        assert all(a + n + 1 == b for (_, a, n), (_, b, _) in zip(own, own[1:]))


def test_token_counts_edges(spark):
    ids = plain(BYTE, literal=True)
    got = token_counts.count_tokens(edge_docs(spark)).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=key) == sorted(((d, len(ids(t))) for d, t in EDGES), key=key)
    assert token_counts.count_tokens(empty_docs(spark)).count() == 0
