"""The filter audit against a plain simulation of every order."""

import itertools
import random
import re
from collections import Counter

from folioscope.llm import filter_audit

DOCS = "doc_id long, text string, lang string, part int, mask string"
LABELS = "doc_id long, quality int, toxic int, same string"


def fails(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text))}


def brute(docs, labels):
    rows = []
    for i, t, lang in docs:
        t = t or ""
        own = fails(t)
        own["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        rows.append((lang or "", {x for x, bad in own.items() if bad},
                     any(i is not None and a == i and q == 1 for a, q, _ in labels), any(i is not None and a == i and x == 1 for a, _, x in labels)))
    out, shapley = [], Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                shapley[part, x] += len(gone)
                out.append((part, "".join(order), k + 1, len(left), len(gone), sum(x in r[1] for r in mine) - len(gone),
                            sum(r[1] == {x} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)))
    return sorted(r + (shapley[r[0], r[1][r[2] - 1]],) for r in out)


def check(spark, docs, labels):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(*r, "x") for r in labels], LABELS)
    got = filter_audit.audit(filter_audit.cells(d, q))
    assert got.columns == ["part", "filter_order", "step", *filter_audit.FIGURES, "shapley"]
    assert sorted(map(tuple, got.collect())) == brute(docs, labels)


def test_mixed(spark):
    draw = random.Random(1)
    texts = [" ".join(draw.choice(["a", "b", "Cd", "#x", "é", f"w{draw.randrange(500)}"]) for _ in range(draw.choice([3, 199, 200, 600]))) for _ in range(30)]
    docs = [(i, draw.choice(texts), draw.choice(["en", "fr", "", None])) for i in range(90)]
    labels = [(draw.randrange(120), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(80)] + [(None, 1, 1)]
    check(spark, docs, labels)


def test_limits(spark):
    """Exactly at each limit, and code points beyond the first plane."""
    words = [f"w{i}" for i in range(200)]
    docs = [" ".join(words), " ".join(words[:199]), " ".join(words[:100] * 2), " ".join(words[:99] + words[:99] + ["w0", "w1"]),
            "A" * 3 + "\U0001F600" * 97, "A" * 4 + "\U0001F600" * 96, "a\x0bb\x0cc d\x1fe", "Word word", "word Word"]
    check(spark, [(i, t, "en") for i, t in enumerate(docs)], [])


def test_odd_rows(spark):
    """Nulls in every column, repeated rows, ids with several texts, a very long text, one text in several parts."""
    long = "x " * 300_000
    docs = [(None, None, None), (None, None, "en"), (None, "t", "en"), (3, "t", "en"), (3, "t", "en"), (3, "t", "fr"), (4, "t", "fr"), (2, "t", None), (2, "t", "en"),
            (5, None, "en"), (1, "", "en"), (5, "", "en"), (5, "other #", "en"), (9, long, "en"), (8, long, "de"), (None, long, "de"), (10, " ", "en")]
    labels = [(3, 1, 0), (3, 0, 1), (3, 1, 1), (2, None, 1), (5, 1, None), (None, 1, 1), (9, 1, 1), (77, 1, 1)]
    check(spark, docs, labels)


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert filter_audit.audit(filter_audit.cells(none, spark.createDataFrame([], LABELS))).count() == 0
