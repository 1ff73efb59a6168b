import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peerlens.llm.tokenizer import TOKENIZERS, Codec, encode_corpus, read_ranks

PATH = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="vocabulary files are absent")
TEXTS = [
    None, "", " ", "\n\n  \t x", "Hello world, it's 2025!", "<|endoftext|>", "naïve ﬁancé Zürich", "записка о переводе", "確認しました。", "👨🏽‍💻 ok", "a\x00\x07b", "bc1q" * 500, "ab" * 100_000, "é" * 30_000, " " * 20_000 + "x", "퟿",
]


@pytest.fixture(scope="module")
def own():
    return Codec(PATH)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    from peerlens.llm.tokenizer import PATTERN

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def test_against_an_independent_encoder(own, reference):
    assert own.encode_batch(TEXTS) == [reference.encode_ordinary(t) if t else [] for t in TEXTS]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_round_trip_and_ids(own, reference, text):
    ids = own.encode_batch([text])[0]
    assert ids == reference.encode_ordinary(text)
    assert own.decode(ids) == text


def test_corpus(spark, own):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)]
    got = {r["doc_id"]: list(r["ids"]) for r in encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()}
    assert got == dict(enumerate(own.encode_batch(TEXTS)))
    assert encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0
