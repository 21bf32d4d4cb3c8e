import random

import pytest

from foliospark.llm import tokens


def texts():
    rng = random.Random(7)
    words = ["the", "a1b2", "naïve", "it's", "  ", "\n\n", "...", "漢字", "😀", "x" * 30, "12345", "\t", "don't"]
    out = [None, "", " ", "a", "'s", "<|endoftext|>"]
    out += [" ".join(rng.choices(words, k=n)) for n in (5, 60, 300, 1200)]
    out += ["z" * 900, " " * 700 + "end", "ab" * 40 + " " * 300 + "cd " * 100, "word " * 64 + "e" * 200]
    return out


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (100, 90), (8192, 512)])
def test_equal_to_whole_text(spark, chunk, overlap):
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(df, chunk_chars=chunk, overlap_chars=overlap).collect()}
    want = {i: v for i, v in enumerate(tokens.encode_texts(texts(), tokens.VOCABULARY))}
    assert got == want
    assert all(tokens.decode_ids(v) == (texts()[i] or "").encode() for i, v in got.items())
    back = spark.createDataFrame([(i, v) for i, v in want.items()] + [(-1, None)], "doc_id bigint, ids array<int>").select("doc_id", tokens.decoded("ids").alias("b")).collect()
    assert {r.doc_id: r.b if r.b is None else bytes(r.b) for r in back} == {-1: None, **{i: (t or "").encode() for i, t in enumerate(texts())}}


def test_empty_table(spark):
    assert tokens.encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
