"""Token counts against the library on whole texts."""

import random

import public_tokenizers
import pytest

from docmill.llm.token_count import Splicer, count_tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def small():
    return Splicer(MODEL, chunk=64, overlap=4)


@pytest.mark.parametrize("seed", range(60))
def test_spliced_equals_whole(small, seed):
    r = random.Random(seed)
    parts = ["the", "token", "  ", " ", "\n", "日本", "é", "é", "▁", "aaaa", "𐍈", "<s>", "12345", "    ", ".", "internationalization", "x" * 90]
    text = "".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randrange(400)))
    assert small.encode(text) == list(small.sp.encode(text))


def test_no_boundary_widens(small):
    text = "a" * 3000
    before = small.widened
    assert small.encode(text) == list(small.sp.encode(text))
    assert small.widened > before


def test_edges(spark):
    long = "word, and other ways. " * 5000
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x"), (4, long, None)]
    out = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), MODEL, chunk=1000).collect()
    sp = Splicer(MODEL).sp
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in out) == [(1, 0, 0), (2, 0, 0), (3, 3, len(sp.encode("a b"))), (3, 3, len(sp.encode("a b"))), (4, len(long), len(sp.encode(long)))]
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0
