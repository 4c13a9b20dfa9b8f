"""Byte-level BPE against the tiktoken library, and the exact round trip."""

import base64
import random
import struct

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from docmill.llm import segments
from docmill.llm.bpe import ByteBpe, digests, encode_column

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return ByteBpe(FILE, public_tokenizers.PATTERN)


PARTS = ["the", "Hello", " ", "  ", "\n", "\n ", "\t", "日本語", "é", "👩‍👩‍👧", "don't", "12345", "...!!", "internationalization", " ", " x", "x" * 300, "ab" * 200, "<|endoftext|>", "\x1c", "\x85", "×", "÷", "İ", "ſ", "\u00a0", "one\ntwo", "\r\n", "'s", "'", "x\ty", "Ünï,ö!", "a1b2", "\u3000", "ĳ.", "\x00", "ñ\u0301"]


@pytest.mark.parametrize("seed", range(25))
def test_equals_library(own, library, seed):
    r = random.Random(seed)
    texts = ["".join(r.choice(PARTS) + r.choice(["", " "]) for _ in range(r.randrange(60))) for _ in range(20)]
    ids, bounds = own.encode(pa.array(texts))
    for t, lo, hi in zip(texts, bounds, bounds[1:]):
        assert ids[lo:hi].tolist() == library.encode_ordinary(t)
    assert own.decode(ids, bounds) == [t.encode() for t in texts]


def test_long_texts_in_pieces(own, library, monkeypatch):
    monkeypatch.setattr(segments, "LONG", 40)
    r = random.Random(1)
    texts = [" ".join(r.choice(PARTS) for _ in range(r.randrange(200))) for _ in range(20)] + ["", "a b " * 50, " ", "x" * 500]
    ids, bounds = own.encode(pa.array(texts))
    assert [ids[lo:hi].tolist() for lo, hi in zip(bounds, bounds[1:])] == [library.encode_ordinary(t) for t in texts]


def test_words_without_heap(own, library):
    r = random.Random(1)
    words = [bytes(r.choice(b"abcdetsnr") for _ in range(r.randrange(1, 200))) for _ in range(300)]
    assert [x.tolist() for x in own.encode_words(words)] == [library.encode_ordinary(w.decode()) for w in words]


def test_edges(spark, library):
    long = "some words and more " * 30_000
    rows = [(1, None, 0), (2, "", 0), (3, "a  b", 0), (3, "a  b", 0), (4, long, 0)]
    out = digests(encode_column(spark.createDataFrame(rows, "doc_id long, text string, ids int"), FILE, public_tokenizers.PATTERN)).collect()
    import hashlib

    def want(i, t):
        ids = library.encode_ordinary(t or "")
        return (i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())

    assert sorted(map(tuple, out)) == sorted(want(i, t) for i, t, _ in rows)
    assert digests(encode_column(spark.createDataFrame([], "doc_id long, text string"), FILE, public_tokenizers.PATTERN)).count() == 0
