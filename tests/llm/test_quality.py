"""Repetition rules against a plain count, and odd inputs."""

import random
import re
from collections import Counter

import duckdb
import pytest

from folioscope.llm import quality, queries

SF = "/root/testdata/sf0.001"


def brute(text):
    """All columns, from the rules as the module states them."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars = len(words), sum(map(len, words))

    def inside(width):
        grams = [tuple(words[i:i + width]) for i in range(n - width + 1)]
        seen = Counter(grams)
        return {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + width)}

    hit = inside(5)
    shares = [sum(len(words[j]) for j in inside(w)) / max(chars, 1) for w in range(5, 11)]
    again = [x for k, x in enumerate(lines) if x in set(lines[:k])]
    size = lambda some: sum(len(x.encode()) for x in some)
    line_share, bytes_share = len(again) / max(len(lines), 1), size(again) / max(size(lines), 1)
    failed = n < 10 or 100 * len(hit) > 20 * n
    limits = [0.20, 0.19, 0.18, 0.17, 0.16, 0.15]
    return {
        "n_words": n, "word_chars": chars, "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(again), "n_repeat_words": len(hit), "dup_line_share": line_share, "dup_line_bytes_share": bytes_share,
        "dup_char_shares": shares, "base_failed": failed,
        "kept": not (failed or line_share > 0.3 or bytes_share > 0.3 or any(x > y for x, y in zip(shares, limits))),
    }


def compare(rows, texts):
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want, r["doc_id"]
        assert not (r["kept"] and r["base_failed"])


def test_the_table(spark):
    """Every column of every text, whole."""
    rows = queries.QUERIES["op9_repetition"](spark, SF).collect()
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    assert len(rows) == len(texts) and {r["kept"] for r in rows} == {True, False}
    compare(rows, texts)


def test_texts_around_the_limits(spark):
    draw = random.Random(8)
    texts = {}
    for i in range(300):
        words = [f"w{draw.randrange(400)}" for _ in range(draw.choice([9, 10, 40, 120]))]
        for _ in range(draw.randrange(3)):
            a, n = draw.randrange(len(words)), draw.randrange(1, 14)
            words[draw.randrange(len(words)):0] = words[a:a + n]
        texts[i] = "".join(w + draw.choice([" ", " ", " ", "\n"]) for w in words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = quality.judge(df).collect()
    compare(rows, texts)
    assert sum(r["kept"] for r in rows) not in (0, 300)


def test_ids_that_are_texts(spark):
    assert quality.judge(spark.createDataFrame([("a", "x y")], "doc_id string, text string")).first()["doc_id"] == "a"


ODD = [None, "", " \n\t ", "one", "a\n\na\nb\n a\na", "é ü x é", "ok " * 500, "\x00 a \x1c b", "x\r\nx\r\n",
       "a b c d e f a b c d e g " * 2, "w" * 100_000, "\n", "a\n", "a", "|<>| $$"]


def test_odd_texts(spark):
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(ODD)] + [(3, "one", "m")],
                               "doc_id long, text string, kept string")
    rows = quality.judge(df).collect()
    assert len(rows) == len(ODD) + 1
    compare(rows, dict(enumerate(ODD)))


def test_empty_table_and_null_id(spark):
    df = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert quality.judge(df).first()["n_words"] == 2
    assert quality.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize("text,kept", [
    (" ".join(f"w{i}" for i in range(200)), True),
    ("\n".join(["the same line here"] * 30), False),
    (" ".join(f"w{i}" for i in range(60)) + " " + " ".join(f"w{i}" for i in range(11)), False),
    ("five words only in here", False),
])
def test_verdict(spark, text, kept):
    df = spark.createDataFrame([(1, text, "x")], "doc_id long, text string, lang string")
    assert quality.judge(df).first()["kept"] is kept
    assert quality.passing(df).count() == int(kept)
    assert quality.passing(df).schema == df.schema
