"""Token files: round trips, order, checksums, reading from a checkpoint."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import ans, queries, token_files
from folioscope.llm.shared import stored
from folioscope.session import scratch_path

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(docs):
    """(id, start, n, crc) by the tokenizer library, in order of id and, for equal ids, by ids."""
    t = Tokenizer.from_file(PATH)
    rows = [(i, np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")) for i, x in docs]
    out, at = [], 0
    for i, ids in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op11_token_files"](spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    assert sorted(map(tuple, got.collect())) == sorted(brute(map(tuple, docs)))


def written(spark, docs, schema="doc_id long, text string, id int, ids string", **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], schema).repartition(3)
    tokens, wide = token_files.tokenized(df, PATH, end_id=2)
    path = scratch_path(spark, "files")
    token_files.write(stored(tokens), path, wide)
    return path


def rows(spark, path):
    return [tuple(r) for r in token_files.read(spark, path).select("id", "start", "n", F.crc32("ids")).collect()]


def test_odd_rows(spark, monkeypatch):
    """Nulls, empty and very long texts, repeated rows, several blocks and segments."""
    monkeypatch.setattr(token_files, "BLOCK_IDS", 3000)
    docs = [(7, None), (3, ""), (None, "x"), (None, None), (4, "word " * 70_000), (5, "é\x00\U0001F600 <|endoftext|>"), (6, "a b"), (6, "a b"), (-1, "minus")]
    docs += [(100 + i, f"text {i} " * (i % 40)) for i in range(300)]
    path = written(spark, docs)
    got, want = rows(spark, path), brute(docs)
    assert sorted(r[2:] for r in got if r[0] is None) == sorted(r[2:] for r in want if r[0] is None)
    assert sorted(r for r in got if r[0] is not None) == [r for r in want if r[0] is not None]
    assert sorted(r[1] for r in got) == sorted(np.cumsum([0] + [r[2] for r in sorted(got, key=lambda r: r[1])])[:-1].tolist())
    stream = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in sorted(token_files.read(spark, path).collect(), key=lambda r: r["start"])])
    for start, stop in [(0, 1), (16380, 16390), (len(stream) - 5, len(stream) + 9), (20_000, 60_001), (5, 5)]:
        pieces = sorted(token_files.between(spark, path, start, stop).collect(), key=lambda r: r["start"])
        assert [i for r in pieces for i in r["ids"]] == stream[start:stop].tolist()
        assert not pieces or pieces[0]["start"] == start


def test_pre_tokens_are_asked_from_the_model(monkeypatch):
    """Whole texts go to the library for special tokens and unknown code points only; the ids are the library's."""
    t, asked, own = Tokenizer.from_file(PATH), [], token_files._Encoder._ask
    monkeypatch.setattr(token_files._Encoder, "_ask", lambda self, texts: asked.extend(texts) or own(self, texts))
    every = "".join(chr(c) for c in range(0x2000) if chr(c).isprintable() or c < 0x100)
    plain = ["", "it's  we'll 'sfoo\n\n x\t y", "\x00\x7f\xa0\xad", "word" * 900 + " " * 90, "中文 \U0001F600é ½", *(f"{x} w{x}" for x in every.split(" "))]
    odd = ["a <|endoftext|> b", "x\u0378"]
    assert [list(x) for x in token_files._Encoder(PATH, token_files.pretokens.classes())(plain + odd)] == [t.encode(x, add_special_tokens=False).ids for x in plain + odd]
    assert set(odd) <= set(asked) <= {x for x in plain + odd if x in odd or not x.isascii()}


def test_byte_level():
    from tokenizers.pre_tokenizers import ByteLevel

    assert sorted(token_files.BYTE_LEVEL.values()) == sorted(ByteLevel.alphabet())
    for c in map(chr, range(0x2000)):
        assert "".join(p for p, _ in ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)) == c.encode().decode("latin-1").translate(token_files.BYTE_LEVEL)


def test_other_ids_and_empty(spark):
    path = written(spark, [("b", "t"), ("a", "u v"), (None, "w")], "doc_id string, text string, id int, ids string")
    assert [r[0] for r in sorted(rows(spark, path), key=lambda r: r[1])] == [None, "a", "b"]
    assert rows(spark, written(spark, [])) == []


def test_damage_is_found(spark):
    path = written(spark, [(1, "some words " * 5000)])
    files, where = fs.FileSystem.from_uri(f"{path}/blocks")
    name = files.get_file_info(fs.FileSelector(where))[0].path
    data = bytearray(files.open_input_file(name).read())
    data[len(data) // 2] ^= 1
    with files.open_output_stream(name) as out:
        out.write(bytes(data))
    with pytest.raises(PythonException, match="checksum"):
        rows(spark, path)


def test_frequencies():
    draw = np.random.default_rng(2)
    for counts in ([5], [0, 0, 3], [1] * 50_000, [10 ** 14] + [1] * 60_000, draw.integers(0, 9, 5000), (1e9 / np.arange(1, 50_000) ** 2).astype(int)):
        f = ans.frequencies(counts)
        assert f.sum() == ans.TOTAL and ((f > 0) == (np.asarray(counts) > 0)).all()
    assert ans.frequencies([0, 0]).sum() == 0 and len(ans.frequencies([])) == 0


def test_coder():
    """Any lengths side by side; close to the entropy; a token without a frequency is refused."""
    draw = np.random.default_rng(1)
    p = 1 / np.arange(1, 3001)
    p /= p.sum()
    blocks = [draw.choice(3000, n, p=p) for n in (0, 1, 31, 32, 33, 16_383, 16_384, 16_385, 50_000)] + [np.full(40_000, 7)]
    model = ans.Model(ans.frequencies(np.bincount(np.concatenate(blocks), minlength=3000)))
    coded = ans.encode(blocks, model, [b"index"] * len(blocks))
    parts = [ans.Block(c) for c in coded]
    assert all(b.index == b"index" for b in parts)
    for got, want in zip(ans.decode([(b, 0, b.segments) for b in parts], model), blocks):
        assert got.tolist() == want.tolist()
    assert ans.decode([(parts[8], 1, 2)], model)[0].tolist() == blocks[8][16_384:32_768].tolist()
    counts = np.bincount(np.concatenate(blocks)) / sum(map(len, blocks))
    bits = -(counts[counts > 0] * np.log2(counts[counts > 0])).sum()
    assert sum(map(len, coded)) * 8 < 1.05 * bits * sum(map(len, blocks)) + 8 * 700 * len(blocks)
    with pytest.raises(ValueError, match="not in the frequency table"):
        ans.encode([np.array([2999])], ans.Model(ans.frequencies([1] * 10 + [0] * 2990)), [b""])
