"""Problem 7: exact agreement with the tokenizer, whatever the cuts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from candlery.llm import encode

pytest.importorskip("tiktoken")
ALPHABET = "ab'sdlre  \n\t1２中文กخ.!?é́😀 ​<|>"


@pytest.fixture(scope="module")
def own():
    return encode.Encoder()


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=200))
def test_any_cut_agrees(own, text):
    before, encode.CHUNK_AVERAGE = encode.CHUNK_AVERAGE, 4
    try:
        assert own.encode(text).tolist() == own._encode(text)
    finally:
        encode.CHUNK_AVERAGE = before


def test_long_and_shared(own):
    text = "The quick brown fox. " * 3000 + "中" * 9000 + " " * 500 + "x"
    assert own.encode(text).tolist() == own._encode(text)
    assert own.encode(text + text).tolist() == own._encode(text + text)


def test_documents(spark):
    rows = [(1, "hello <|endoftext|> world", "x"), (2, None, "x"), (3, "", "x"), (4, " ", "x"), (1, "again", "x"), (None, "no id", "x")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    own = encode.Encoder()
    out = sorted(((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in encode.encode_documents(documents).collect()))
    assert out == sorted((i is not None, i or 0, own._encode(t) if t else []) for i, t, _ in rows)
    counts = {(r.doc_id, r.n_tokens) for r in encode.token_counts(documents).collect()}
    assert (2, 0) in counts and (4, 1) in counts
    assert encode.encode_documents(documents.limit(0)).count() == 0
