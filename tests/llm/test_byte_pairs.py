"""Token ids against the tokenizer library, and back to the bytes."""

import random

import duckdb
import public_tokenizers
import pytest
import tiktoken

from folioscope.llm import byte_pairs, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return byte_pairs.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def codec(ranks):
    return byte_pairs.Codec(ranks, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def judge(ranks):
    return tiktoken.Encoding("judge", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash(ranks, codec):
    assert sorted(codec.whole.values) == sorted(ranks.values())
    assert all(codec.whole.get(t) == r for t, r in ranks.items())
    assert codec.whole.get(b"no such token at all") is None


def test_table(spark, judge):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    import hashlib

    rows = queries.QUERIES["op4_byte_pairs"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = judge.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_random_texts(codec, judge):
    draw = random.Random(5)
    spaces = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 ᠎     　​﻿"
    letters = "abcXYZ'stremvdl019,.<|>éßΣς漢字かな한글🙂🏽́‍²½ⅧØ\U0001F1E6ʰꟲᲉ"
    for _ in range(4000):
        text = "".join(draw.choice(spaces if draw.random() < 0.3 else letters) for _ in range(draw.randrange(40)))
        assert codec.encode(text) == judge.encode_ordinary(text), ascii(text)
        assert codec.decode(codec.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["", "a" * 20_000, "ab" * 5_000, " " * 3_000, "<|endoftext|>", "x" * 65 + " y"])
def test_long_and_odd(codec, judge, text):
    assert codec.encode(text) == judge.encode_ordinary(text)


def test_rows(spark, codec):
    df = spark.createDataFrame([(1, None, "k"), (1, None, "k"), (None, "a b", "z"), (3, "", None)], "doc_id long, text string, ids string")
    out = byte_pairs.decode(byte_pairs.encode(df, codec), codec)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = sorted((r["text"] or "", len(r["ids"]), bytes(r["decoded"])) for r in out.collect())
    assert got == [("", 0, b""), ("", 0, b""), ("", 0, b""), ("a b", 2, b"a b")]
    assert byte_pairs.encode(df.limit(0), codec).count() == 0
