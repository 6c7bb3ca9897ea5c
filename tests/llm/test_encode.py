import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import encode

tiktoken = pytest.importorskip("tiktoken")
RANKS = encode.read_ranks(encode.vocabulary_path())
ENCODER = encode.Encoder(RANKS)
REFERENCE = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_random_texts(text):
    assert ENCODER.encode(text) == REFERENCE.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 9_000, "日本語" * 4_000, " " * 5_000, "<|endoftext|>", "x\u0000y", "é" * 999, "'s don't  \n\n x"])
def test_long_and_odd_texts(text):
    assert ENCODER.encode(text) == REFERENCE.encode_ordinary(text)


def test_rank_queue_pops_in_order():
    import random

    q, rng = encode.RankQueue(), random.Random(1)
    pushed = [(rng.choice([0, 63, 64, 4095, 4096, 50_000]), rng.randrange(1000)) for _ in range(500)]
    for r, p in pushed:
        q.push(r, p)
    popped = []
    while (x := q.pop()) is not None:
        popped.append(x)
    assert popped == sorted(pushed)


def test_table(spark):
    df = spark.createDataFrame([(1, "Hello"), (2, ""), (3, None), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id, list(r.ids)) for r in encode.token_ids(spark, df).collect())
    assert got == [(1, REFERENCE.encode_ordinary("Hello")), (2, []), (3, []), (3, [])]
    assert encode.token_ids(spark, df.limit(0)).count() == 0


def test_vocabulary_lines_are_base64():
    assert encode._parse_ranks(base64.b64encode(b"ab") + b" 7\n") == {b"ab": 7}
