import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from rillhouse.llm import bpe, bpe_codec, token_files

SCHEMA = "doc_id long, text string, start string, ids_crc32 int"
TEXTS = ["", None, " ", "one", "a  b\n\n c\t", "<|endoftext|> x<|endoftext|>", "don't 12 é½ 　x \x1c y", "lang " * 5000, "one", "\U0001f600 z q"]


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def small(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "none", "x", 1), (3, "one", "x", 1)], SCHEMA)


def test_encoder_equals_library(lib):
    enc = bpe.Encoder(bpe.Vocabulary(P.path("byte_bpe_50k.json")), remember=50)
    other = token_files.LibraryEncoder(P.path("byte_bpe_50k.json"), most=50)
    rng = random.Random(3)
    odd = ["".join(rng.choice(" \n\t\x1c ab1'é.,　s<|") for _ in range(rng.randint(1, 30))) for _ in range(500)]
    for t in [x or "" for x in TEXTS] + odd:
        want = lib.encode(t, add_special_tokens=False).ids
        assert enc.encode(t).tolist() == want
        assert enc.decode(want) == lib.decode(want, skip_special_tokens=False)
        assert np.frombuffer(other.encode([t])[0], "<u4").tolist() == want
    v = enc.v
    for w in ("hello", " unbelievably", "éà", "zzzzqqq"):
        assert v.merged(w.encode()) == v.unseen(w.encode())


def test_lexicon_is_exact_and_shares_suffixes():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["tap", "taps", "top", "tops", "é", "x"])}
    lex = bpe.Lexicon.mapped(bpe.compile_lexicon(words))
    assert all(lex.get(w) == ids for w, ids in words.items())
    assert [lex.get(w) for w in (b"", b"t", b"ta", b"tapsx", b"y")] == [None] * 5
    assert lex.n_states < 1 + sum(map(len, words))
    assert bpe.Lexicon.mapped(bpe.compile_lexicon({})).get(b"a") is None


def test_codec(spark, lib):
    rows = bpe_codec.with_ids(small(spark).select("doc_id", "text"), words=3).collect()
    want = []
    for i, t in [*enumerate(TEXTS), (None, "none"), (3, "one")]:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    both = bpe_codec.decode(bpe_codec.encode(small(spark)))
    assert all((r["text"] or "") == r["decoded"] for r in both.collect())
    assert bpe_codec.with_ids(small(spark).limit(0).select("doc_id", "text")).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 64, 65, 1000):
        for top in (0, 1, 5, 100_000):
            v = np.sort(rng.integers(0, top + 1, n))
            ef = token_files.EliasFano.encode(v)
            assert ef.all().tolist() == v.tolist() == [ef.select(i) for i in range(n)]
    big = np.sort(rng.integers(0, 10_000_000, 10_000))
    ef = token_files.EliasFano.encode(big)
    assert 8 * (ef.low.nbytes + ef.high.nbytes) < 13 * 10_000 < 64 * 10_000


def test_token_files(spark, lib, tmp_path):
    uri = "file://" + str(tmp_path / "t")
    rows = token_files.read(spark, uri, token_files.write(small(spark), uri, shards=3)).collect()
    docs = sorted([*enumerate(TEXTS), (None, "none"), (3, "one")], key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for i, t in docs:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    empty = "file://" + str(tmp_path / "e")
    assert token_files.read(spark, empty, token_files.write(small(spark).limit(0), empty)).count() == 0


def test_queries_on_whole_tables(spark, sf, lib):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    ids = {i: lib.encode(t, add_special_tokens=False).ids for i, t in docs.items()}
    got = {r["doc_id"]: r for r in bpe_codec.query(spark, sf).collect()}
    assert got.keys() == docs.keys()
    assert all(r["decoded_sha256"] == hashlib.sha256(docs[i].encode()).hexdigest() and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids[i])).encode()).hexdigest() for i, r in got.items())
    at = 0
    files = {r["doc_id"]: r for r in token_files.query(spark, sf).collect()}
    for i in sorted(docs):
        assert (files[i]["start"], files[i]["n_tokens"]) == (at, len(ids[i]) + 1)
        assert files[i]["ids_crc32"] == zlib.crc32(np.array([*ids[i], 2], "<u4").tobytes())
        at += len(ids[i]) + 1


def test_places_of_hashes_equal_a_binary_search():
    rng = np.random.default_rng(7)
    memo = bpe.Memo(None, None, [])
    for n in (30_000, 200_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        memo.clear()
        memo.put(keys, np.zeros(len(keys), np.uint32), np.ones(len(keys), np.int64))
        assert len(memo.keys[0]) == len(keys)
        asked = np.concatenate((keys[::7], rng.integers(0, 1 << 63, 50_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)))
        assert (memo.place(asked) == np.searchsorted(keys, asked)).all()
