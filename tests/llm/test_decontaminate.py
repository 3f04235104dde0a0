"""Benchmark hits against a scan of all windows, and the plan."""

import random
import re

import pytest

from folioscope.llm import decontaminate
from tests.conftest import plan


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, width=10):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[k:k + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                who = wins.get(tuple(w[k:k + n]))
                if who:
                    hit |= set(range(k, k + n))
                    found |= {str(x) for x in who if x is not None}
        out.append((i, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=str)


def check(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, items string").repartition(3)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, window string")
    got = decontaminate.hits(d, b, **more)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items", "contaminated"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, **more)
    joined = decontaminate.hits(d, b, sent_bytes=-1, **more)
    assert sorted((tuple(r) for r in joined.collect()), key=str) == brute(docs, items, **more)
    return got


@pytest.mark.parametrize("seed,alphabet", [(1, 3), (2, 12), (3, 200)])
def test_random(spark, seed, alphabet):
    draw = random.Random(seed)
    word = lambda: draw.choice(["w", "W", "É", "é", "ß"]) + str(draw.randrange(alphabet))
    items = [(k, " ".join(word() for _ in range(draw.choice([0, 1, 2, 5, 9, 10, 11, 30])))) for k in range(25)]
    docs = []
    for i in range(60):
        parts = [word() for _ in range(draw.randrange(30))]
        for _ in range(draw.randrange(3)):
            w = draw.choice(items)[1].split()
            a = draw.randrange(len(w) + 1)
            parts += w[a:a + draw.randrange(1, 15)]
        docs.append((i, draw.choice([" ", ", ", "\n"]).join(parts)))
    check(spark, docs, items)


def test_odd(spark):
    long = " ".join(f"v{i}" for i in range(5000))
    items = [(1, "alpha beta"), (2, None), (3, ""), (4, "!!!"), (5, "solo"), (None, "gamma delta"), (1, "alpha beta"), (7, "ΟΔΟΣ'a ΟΔΟΣ İI x"), (8, long[-70:]),
             (9, "ok " * 30)]
    docs = [(0, None), (1, ""), (2, "..."), (3, "Alpha, BETA alpha"), (4, "beta alpha"), (5, "a solo b SOLO"), (6, "gamma delta"), (7, "y ΟΔΟΣ'A ΟΔΟΣ İi X"),
            (8, "οδοσ'a οδοσ i̇i x"), (9, long), (9, long), (None, "alpha beta"), (11, "ok " * 500), (12, " solo"), (13, "ok " * 9)]
    check(spark, docs, items)
    check(spark, docs, [])
    check(spark, [], items)


def test_clean_and_plan(spark):
    d = spark.createDataFrame([(1, "alpha beta", "k"), (2, "beta alpha", "l"), (None, None, "m")], "doc_id long, text string, start string")
    b = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    assert sorted(r["start"] for r in decontaminate.clean(d, b).collect()) == ["l", "m"]
    text = plan(decontaminate.hits(d, b))
    assert "Python" not in text and "Arrow" not in text and "NestedLoop" not in text and "Cartesian" not in text


def test_ids_that_are_texts_and_names_that_clash(spark):
    d = spark.createDataFrame([("a", "alpha beta", 1, 2, 3), ("b", "beta", 4, 5, 6), (None, "beta", 7, 8, 9)], "doc_id string, text string, __i int, __h int, __bad0 int")
    b = spark.createDataFrame([("x", "alpha beta")], "item_id string, text string")
    assert sorted((str(r.doc_id), r.n_hit, r["items"]) for r in decontaminate.hits(d, b).collect()) == [("None", 0, []), ("a", 2, ["x"]), ("b", 0, [])]
    got = decontaminate.clean(d, b)
    assert got.columns == d.columns and sorted(r["__i"] for r in got.collect()) == [4, 7]


def test_clean_judges_rows_by_their_text(spark):
    rows = [(None, "alpha beta", "gone"), (None, "clean", "a"), (None, None, "b"), (None, "clean", "c"), (None, "x Alpha, beta", "gone"),
            (7, "alpha beta", "gone"), (7, "other", "d"), (0, "clean", "e"), (0, None, "f"), (8, "alpha beta", "gone"), (8, "alpha beta", "gone")]
    d = spark.createDataFrame(rows, "doc_id long, text string, i string").repartition(3)
    b = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    got = decontaminate.clean(d, b)
    assert got.columns == d.columns and sorted(r["i"] for r in got.collect()) == list("abcdef")
