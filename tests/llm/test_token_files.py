"""Token files: exact round trip against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from docmill.llm import segments
from docmill.llm.common import scratch_path
from docmill.llm.token_files import _Words, digest, encode_documents, id_type, read_tokens, splits_at_spaces, write_tokens

MODEL = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["the", "Hello", " ", "  ", "\n", "\t", "日本語", "é", "don't", "123", "...!!", "É.", "x1", "<|endoftext|>", "<|ENDOFTEXT|>", "\x1c", "\x85", "×", "÷", "İ", "ſ", "\u00a0", "one\ntwo", "'s", "'", "Ünï,ö!", "\u3000", "\x00", "ñ\u0301", "e\u0301", "|>", "<|", "ΣΑΣ"]
TEXTS = [None, "", "Hello  wörld's  end", " \n\t x  ", "A<|endoftext|>B <|startoftext|> é É", "ΣΑΣ Σ", "a b　c", "日本 ́x 12345", "long " * 40_000]


def test_words_many_at_a_time():
    r = random.Random(3)
    words = ["".join(r.choice("abcdeéüßıĳOAÉ") for _ in range(r.randrange(1, 12))) + r.choice(["", "", ".", ",!?", "|", "'s", "5", "İ"]) for _ in range(3000)]
    tok = Tokenizer.from_file(MODEL)
    words += ["one.", "a|b", "((x))", "Ünï,ö!", "...", "\n", "a/b-c", "<|endoftext|>x", "don't.", "x1.", ""]
    assert [np.frombuffer(x, np.uint32).tolist() for x in _Words(MODEL)(words)] == [tok.encode(w, add_special_tokens=False).ids for w in words]


@pytest.mark.parametrize("seed", range(10))
@pytest.mark.parametrize("long", [1 << 23, 30])
def test_parts_of_texts(monkeypatch, seed, long):
    monkeypatch.setattr(segments, "LONG", long)
    r = random.Random(seed)
    texts = ["".join(r.choice(PARTS) + r.choice(["", " "]) for _ in range(r.randrange(60))) for _ in range(30)]
    index, parts, bounds = segments.cut_parts(pa.array(["skipped", *texts])[1:], spaces=False)
    cache, tok = segments.SegmentCache(_Words(MODEL), 10_000), Tokenizer.from_file(MODEL)
    flat, ends = cache.gather(cache.slots(parts)[index], bounds)
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_splits():
    assert splits_at_spaces(MODEL)


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_round_trip(spark, parts):
    rows = [(i * 3 % 29, t, "n") for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    path = scratch_path(spark, "test")
    write_tokens(encode_documents(docs, MODEL, end_id=2), docs, path, parts)
    got = sorted(tuple(r) for r in digest(read_tokens(spark, path), id_type(MODEL)).collect())
    tok, want, start = Tokenizer.from_file(MODEL), [], 0
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        start += len(ids)
    assert got == sorted(want)


def test_null_ids_and_wide_vocabularies(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (-1, "c", 2), (3, None, 3)], "doc_id long, text string, start int")
    path = scratch_path(spark, "test")
    write_tokens(encode_documents(docs, MODEL, end_id=2), docs, path, 2)
    assert sorted((r.start, r.id, r.n_tokens) for r in read_tokens(spark, path).collect()) == [(0, None, 3), (3, -1, 2), (5, 3, 1)]
    assert id_type(MODEL) == np.dtype("<u2")
    with pytest.raises(ValueError, match="does not fit"):
        encode_documents(docs, MODEL, end_id=70_000)


def test_empty_and_repeats(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = scratch_path(spark, "test")
    write_tokens(encode_documents(docs, MODEL), docs, path, 4)
    assert read_tokens(spark, path).count() == 0
    docs = spark.createDataFrame([(5, "a b"), (5, "a b"), (5, "c")], "doc_id long, text string")
    path = scratch_path(spark, "test")
    write_tokens(encode_documents(docs, MODEL, end_id=2), docs, path, 4)
    assert sorted((r.start, r.n_tokens) for r in read_tokens(spark, path).collect()) in ([(0, 3), (3, 3), (6, 2)], [(0, 2), (2, 3), (5, 3)], [(0, 3), (3, 2), (5, 3)])
