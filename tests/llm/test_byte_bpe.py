import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tessella.llm.byte_bpe import RankBitmap, bpe_decode, bpe_digests, bpe_encode, codec

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    out = ["", "a", "aaaa" * 50, "the " * 9, "  \n\t x  ", "<|endoftext|>", "don't we'll  I'M", "é" * 31, "日本語テキスト", "🙂🙃" * 5, "\x00\x1c\x1f\x85\xa0 z", "x" * 1000 + "y" * 999]
    for alphabet in ("ab", "theandi ", "etaoin shrdlu\n", "0123456789 .,", "äöüßéèñ abc", "".join(map(chr, range(1, 400)))):
        out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(60)]
    return out


def test_same_ids_as_the_library(reference):
    own = codec(PATH, PATTERN)
    rows = texts()
    got = [ids[a:z].tolist() for ids, bounds in own.encode_texts(rows) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [reference.encode_ordinary(x) for x in rows]


def test_real_documents(spark, sf_dir, reference):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe_digests(docs, PATH, PATTERN).collect():
        ids = reference.encode_ordinary(rows[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()


def test_round_trip_nulls_and_other_columns(spark):
    rows = [(1, "hello  world", "x"), (2, None, "y"), (3, "", None), (1, "hello  world", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe_decode(bpe_encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted(bytes(r.decoded).decode() for r in got) == ["", "", "hello  world", "hello  world"]
    assert bpe_encode(docs.limit(0), PATH, PATTERN).count() == 0
    empty = [r for r in bpe_digests(docs, PATH, PATTERN).collect() if r.doc_id in (2, 3)]
    assert {(r.n_tokens, r.ids_sha256) for r in empty} == {(0, hashlib.sha256(b"").hexdigest())}


def test_a_very_long_pretoken_takes_linear_time(reference):
    rng = random.Random(1)
    long = "".join(rng.choice("etaoinshrdlu") for _ in range(200_000))
    began = time.time()
    (ids, bounds), = codec(PATH, PATTERN).encode_texts([long])
    assert time.time() - began < 30
    assert ids.tolist() == reference.encode_ordinary(long)


def test_ids_outside_the_vocabulary_are_refused():
    with pytest.raises(ValueError):
        codec(PATH, PATTERN).decode(np.array([10**6]), np.array([0, 1]))


def test_bitmap_finds_the_least_member():
    rng, have, bits = random.Random(2), set(), RankBitmap(50_000)
    for _ in range(3000):
        x = rng.choice(sorted(have)) if have and rng.random() < 0.5 else rng.randrange(50_000)
        (bits.discard if x in have else bits.add)(x)
        have ^= {x}
        assert bits.first() == min(have, default=-1)


def test_runs_that_are_encoded_apart_give_the_same_ids(reference, monkeypatch):
    from tessella.llm import byte_bpe as B

    rng = random.Random(3)
    texts = ["".join(rng.choice(["the ", "cat", "é", " 12", "\n\n", "xyz"]) for _ in range(rng.randrange(200))) for _ in range(60)] + [None, ""]
    for piece, flush in ((50, 50), (1, 1), (300, 5000)):
        monkeypatch.setattr(B, "PIECE_CHARS", piece)
        monkeypatch.setattr(B, "FLUSH_CHARS", flush)
        got = [ids[a:z].tolist() for ids, bounds in codec(PATH, PATTERN).encode_texts(texts) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
        assert got == [reference.encode_ordinary(x or "") for x in texts]
    assert list(codec(PATH, PATTERN).encode_texts([])) == []
