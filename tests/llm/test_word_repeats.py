"""Repeated word windows against a plain count of all windows."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest

from folioscope.llm import word_repeats

SF = "/root/testdata/sf0.001"


def brute(texts, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i:i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - width + 1) if count[tuple(w[i:i + width])] > 1 for j in range(i, i + width)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        runs = sum(1 for j in gone if j - 1 not in gone)
        out.append((len(w), len(gone), runs, hashlib.sha256(kept.encode()).hexdigest()))
    return out


def check(spark, texts, width=35, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, spans string").repartition(3)
    got = word_repeats.trimmed(df, width=width)
    assert got.columns == ["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256"]
    mine = sorted((str(r[0]), *r[1:]) for r in got.collect())
    assert mine == sorted((str(i), *b) for i, b in zip(ids, brute(texts, width)))


def test_the_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    check(spark, [t for _, t in rows], ids=[i for i, _ in rows])


@pytest.mark.parametrize("seed,alphabet,width", [(1, 2, 12), (2, 3, 12), (3, 8, 35), (4, 2, 35), (5, 1, 35), (6, 30, 10)])
def test_random_texts_that_share_passages(spark, seed, alphabet, width):
    draw = random.Random(seed)
    word = lambda: "w" * draw.randrange(1, 3) + str(draw.randrange(alphabet))
    pool = [[word() for _ in range(draw.randrange(5, 3 * width))] for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(draw.randrange(1, 6)):
            p = draw.choice(pool)
            a = draw.randrange(len(p))
            parts += p[a:a + draw.randrange(1, 2 * width)] if draw.random() < 0.7 else [word() for _ in range(draw.randrange(1, 20))]
        texts.append(draw.choice([" ", "\n", "  "]).join(parts))
    check(spark, texts, width)


def test_odd_texts(spark):
    long = " ".join(f"v{i}" for i in range(3000))
    check(spark, [None, "", " \n", "a", "ok " * 35, "ok " * 36, "ok " * 34, "é " * 80, "w" * 50_000, long, long + " end",
                  "start " + long, " ".join(f"u{i}" for i in range(35))])


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = " ".join(f"v{i}" for i in range(50))
    check(spark, [text, text, "a b"], ids=[7, 7, 7])
    check(spark, [text, text + " x", "b"], ids=[None, None, None])
    df = spark.createDataFrame([], "doc_id long, text string")
    assert word_repeats.trimmed(df).count() == 0


def test_kept_text(spark):
    text = " ".join(f"v{i}" for i in range(40))
    df = spark.createDataFrame([(1, "mine " + text), (2, text + " yours")], "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in word_repeats.trimmed(df, with_text=True).collect()}
    assert got == {1: "mine", 2: "yours"}
