import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import search
from tests.conftest import plan

BY = ("approach_id", "type")


def expected(items, queries, k=5, digits=6):
    """Brute force over Python rows: (approach, type, id, vector) and (…, query, vector)."""
    def unit(v):
        n = np.linalg.norm(v)
        return np.asarray(v) / n if n else np.asarray(v)

    out = []
    for a, t, q, qv in queries:
        scored = [(-round(float(unit(qv) @ unit(v)), digits) + 0.0, i) for b, u, i, v in items if (a, t) == (b, u)]
        out += [(a, t, q, rank, i, -s + 0.0) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def tables(spark, items, queries, parts=3):
    return (
        spark.createDataFrame(items, "approach_id string, type string, id string, vector array<float>").repartition(parts),
        spark.createDataFrame(queries, "approach_id string, type string, query_id string, vector array<float>"),
    )


def rows(df):
    return sorted((r.approach_id, r.type, r.query_id, r["rank"], r.id, r.score) for r in df.collect())


def random_case(seed, n=400, q=7, copies=0.3):
    """Groups of unequal size in which many vectors are exact copies."""
    rng = np.random.default_rng(seed)
    pool = rng.normal(size=(12, 6)).round(2)
    groups = [("a1", "text"), ("a1", "image"), ("a2", "text")]
    items = []
    for i in range(n):
        a, t = groups[0] if i % 2 else groups[int(rng.integers(3))]
        v = pool[int(rng.integers(12))] if rng.random() < copies else rng.normal(size=6).round(3)
        items.append((a, t, f"i{i:04d}", [float(x) for x in v]))
    queries = [(a, t, f"q{j}", [float(x) for x in pool[j]]) for j in range(q) for a, t in groups]
    as_float = lambda rs: [(*r[:3], [float(np.float32(x)) for x in r[3]]) for r in rs]
    return as_float(items), as_float(queries)


@pytest.mark.parametrize("seed", range(3))
def test_sent_queries_match_brute_force(spark, seed):
    items, queries = random_case(seed)
    got = search.top_k(*tables(spark, items, queries), by=BY)
    assert rows(got) == expected(items, queries)


@pytest.mark.parametrize("seed", range(2))
def test_parts_match_brute_force(spark, seed):
    items, queries = random_case(seed)
    got = search.top_k(*tables(spark, items, queries), by=BY, max_sent_queries=3)
    assert "MapInArrow" not in plan(got)  # every part's hits are a table by now
    assert rows(got) == expected(items, queries)


def test_many_queries_do_not_pass_through_the_driver(spark, monkeypatch):
    """Chunks of three rows, of items and of queries, and nothing is sent."""
    def sent(*_):
        raise AssertionError("queries were collected to be sent")

    monkeypatch.setattr(search, "_send_queries", sent)
    monkeypatch.setattr(search, "CHUNK_BYTES", 3 * 8 * 6)
    monkeypatch.setattr(search, "LEAST_CHUNK", 3)
    items, queries = random_case(4, n=60, q=5)
    items += [(None, "text", "none", queries[0][3])]
    got = search.top_k(*tables(spark, items, queries + [("a9", "text", "q", queries[0][3])]), by=BY, max_sent_queries=4)
    assert rows(got) == expected(items, queries)
    assert search.top_k(*tables(spark, items, [("a9", "text", f"q{j}", [1.0]) for j in range(9)]), by=BY, max_sent_queries=4).isEmpty()


def test_candidates_of_many_queries_are_few():
    rng = np.random.default_rng(2)
    queries, items = search._unit(rng.normal(size=(20_000, 4))), search._unit(rng.normal(size=(4_000, 4)))
    q, _, _ = search._candidates(queries, items, 5, np.full(len(queries), -np.inf), 6)
    assert len(q) < 7 * len(queries)


def test_pairs_without_a_chance_are_not_scored_in_double():
    made = []

    class Seen(np.ndarray):
        def __matmul__(self, other):
            made.append(self.dtype)
            return np.asarray(self) @ np.asarray(other)

    rng = np.random.default_rng(3)
    queries, items = search._unit(rng.normal(size=(300, 16))), search._unit(rng.normal(size=(1500, 16)))
    exact = search._rounded(queries @ items.T, 6)
    for k in (1, 5):
        q, i, s = search._candidates(queries.view(Seen), items, k, np.full(300, -np.inf), 6)
        assert len(q) < 1.5 * k * len(queries) and np.array_equal(s, exact[q, i])
        assert set(zip(q, i)) >= {(a, b) for a in range(300) for b in np.flatnonzero(exact[a] >= np.sort(exact[a])[-k])}
    assert made and set(made) == {np.dtype(np.float32)}


@pytest.mark.parametrize("k", [1, 3])
def test_scores_that_differ_beyond_single_precision(k):
    """Steps of 2e-6 among scores near 1, and of 1e-9 where nothing is rounded; zero and huge vectors beside them."""
    turn = lambda scores: np.stack([scores, np.sqrt(1 - scores ** 2)] + [np.zeros(len(scores))] * 30, axis=1)
    order = np.random.default_rng(7).permutation(900)
    for step, digits, scale in ((2e-6, 6, 1.0), (1e-9, None, 1.0), (1e-9, None, 1e15)):
        items = np.concatenate([turn(0.9 - step * order), np.zeros((40, 32))]) * scale
        queries = np.zeros((3, 32))
        queries[0, 0], queries[2, 0] = 1.0, -1.0
        q, i, s = search._candidates(queries, items, k, np.full(3, -np.inf), digits)
        best = {a: [int(b) for _, b in sorted((-x, b) for c, b, x in zip(q, i, s) if c == a)][:k] for a in range(3)}
        assert best == {0: [int(b) for b in np.argsort(order)[:k]], 1: list(range(k)), 2: list(range(900, 900 + k))}


def test_maxima_hold_every_column():
    rng = np.random.default_rng(8)
    for n, k in ((1, 1), (7, 5), (143, 1), (300, 2), (1000, 1)):
        scores = rng.normal(size=(4, n)).astype(np.float32)
        tops = search._maxima(scores, k)
        width = tops.shape[1]
        assert width >= min(n, k) and np.array_equal(tops, [[row[place::width].max() for place in range(width)] for row in scores])


@pytest.mark.parametrize("limit", [100, 0])
def test_a_crowd_of_equal_scores_is_cut_by_id(spark, limit):
    rng = np.random.default_rng(5)
    names = [f"i{j:04d}" for j in rng.permutation(900)]
    items = [("a1", "text", x, [1.0, 0.0] if j % 3 else [0.0, 1.0]) for j, x in enumerate(names)]
    items += [("a1", "text", "zz", [1.0, 0.1])]
    queries = [("a1", "text", "q", [1.0, 0.0]), ("a1", "text", "r", [1.0, 1.0]), ("a1", "text", "s", [1.0, 0.1])]
    got = search.top_k(*tables(spark, items, queries, parts=2), by=BY, max_sent_queries=limit)
    assert rows(got) == expected(items, queries)


def test_many_blocks_per_task(spark, monkeypatch):
    monkeypatch.setattr(search, "_SCORES_AT_ONCE", 50)
    items, queries = random_case(9)
    got = search.top_k(*tables(spark, items, queries, parts=1), by=BY)
    assert rows(got) == expected(items, queries)


def test_scores_out_of_order_and_unrounded(spark):
    items = [("a1", "text", f"i{j:03d}", [float(j), 1.0]) for j in range(300)]
    queries = [("a1", "text", "q", [1.0, 0.0]), ("a1", "text", "r", [-1.0, 0.0])]
    left, right = tables(spark, items, queries, parts=1)
    got = search.top_k(left.orderBy("id").coalesce(1), right, by=BY, normalize=False, digits=None)
    assert [(r[2], r[4], r[5]) for r in rows(got)] == (
        [("q", f"i{299 - j:03d}", 299.0 - j) for j in range(5)] + [("r", f"i{j:03d}", -float(j)) for j in range(5)])


def test_byte_limit_also_leads_to_parts(spark):
    items, queries = random_case(1, n=30, q=2)
    got = search.top_k(*tables(spark, items, queries), by=BY, max_sent_bytes=10)
    assert "MapInArrow" not in plan(got) and rows(got) == expected(items, queries)


@pytest.mark.parametrize("limit", [100, 1])
def test_a_null_group_has_no_answers(spark, limit):
    items = [(None, "t", "i", [1.0, 0.0]), ("a", "t", "j", [1.0, 0.0]), ("a", None, "k", [1.0, 0.0])]
    queries = [(None, "t", "q", [1.0, 0.0]), ("a", "t", "q", [1.0, 0.0]), ("a", None, "q", [1.0, 0.0])]
    got = search.top_k(*tables(spark, items, queries), by=BY, max_sent_queries=limit)
    assert [(r[0], r[1], r[4]) for r in rows(got)] == [("a", "t", "j")]


def test_equal_ids_of_two_documents(spark):
    items = spark.createDataFrame([("d1", "p1_txt_0", [1.0, 0.0], "one"), ("d2", "p1_txt_0", [1.0, 0.1], "two"), (None, "p1_txt_0", [0.0, 1.0], "none")],
                                  "doc_id string, id string, vector array<double>, body string")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, vector array<double>")
    got = search.top_k(items, asked, key=("doc_id",), fetch=("body",)).orderBy("rank").collect()
    assert [(r.doc_id, r.body) for r in got] == [("d1", "one"), ("d2", "two"), (None, "none")]


def test_best_page_reads_the_text_of_first_hits(spark):
    hits = spark.createDataFrame([("a", "text", "q", 1, "t", 0.5, 3), ("a", "image", "q", 1, "i", 0.4, 4), ("a", "text", "q", 2, "u", 0.4, 9)],
                                 "approach_id string, type string, query_id string, rank int, id string, score double, page int")
    items = spark.createDataFrame([("a", "text", "t", "some  words"), ("a", "text", "u", "other"), ("a", "image", "i", "x")],
                                  "approach_id string, type string, id string, original_text string")
    got = search.best_page(hits, items=items).collect()
    assert [(r.type, r.id, r.page, r.snippet) for r in got] == [("text", "t", 3, "some words")]


def test_best_page_reads_texts_only(spark, tmp_path):
    hits = spark.createDataFrame([("a", "text", "q", 1, "t", 0.5, 3), ("a", "image", "q", 1, "i", 0.4, 4)],
                                 "approach_id string, type string, query_id string, rank int, id string, score double, page int")
    spark.createDataFrame([("a", "text", "t", "some  words"), ("a", "image", "i", "x")],
                          "approach_id string, type string, id string, original_text string").write.partitionBy("type").parquet(str(tmp_path / "v"))
    got = search.best_page(hits, items=spark.read.parquet(str(tmp_path / "v")))
    assert re.search(r"PartitionFilters: \[[^\]]*\(type#\d+ = text\)", plan(got))
    assert [(r.type, r.id, r.snippet) for r in got.collect()] == [("text", "t", "some words")]


def test_fewer_items_than_k_and_unknown_groups(spark):
    items = [("a1", "text", x, [1.0, 0.0]) for x in "bca"]
    queries = [("a1", "text", "q", [1.0, 1.0]), ("a9", "text", "q", [1.0, 1.0])]
    got = rows(search.top_k(*tables(spark, items, queries), by=BY))
    assert [(r[3], r[4]) for r in got] == [(1, "a"), (2, "b"), (3, "c")]


def test_zero_vector_is_found_with_score_zero(spark):
    items = [("a1", "image", "z", [0.0, 0.0]), ("a1", "image", "n", [-1.0, 0.0])]
    queries = [("a1", "image", "q", [1.0, 0.0])]
    assert [(r[4], r[5]) for r in rows(search.top_k(*tables(spark, items, queries), by=BY))] == [("z", 0.0), ("n", -1.0)]


def test_empty_items_and_empty_queries(spark):
    items, queries = random_case(0, n=5, q=1)
    left, right = tables(spark, items, queries)
    assert search.top_k(left.limit(0), right, by=BY).count() == 0
    assert search.top_k(left, right.limit(0), by=BY).count() == 0


@pytest.mark.parametrize("limit", [100, 0])
def test_items_without_a_vector_are_not_found(spark, limit):
    items = [("a", "t", "i", [1.0, 2.0]), ("a", "t", "none", None), ("a", "t", "j", [1.0, 0.0]),
             ("a", "t", "nan", [float("nan"), 0.0]), ("a", "t", "gap", [None, 0.0])]
    got = search.top_k(*tables(spark, items, [("a", "t", "q", [1.0, 0.0])], parts=1), by=BY, max_sent_queries=limit)
    assert [r[4] for r in rows(got)] == ["j", "i"]


def test_different_widths_are_an_error(spark):
    with pytest.raises(Exception, match="width"):
        search.top_k(*tables(spark, [("a", "t", "i", [1.0, 2.0])], [("a", "t", "q", [1.0])]), by=BY).collect()


def test_without_groups_and_with_columns(spark):
    items = spark.createDataFrame([(i, [float(i), 1.0], i % 3, f"text {i}") for i in range(20)],
                                  "id bigint, vector array<double>, label int, body string")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, vector array<double>")
    got = search.top_k(items, asked, k=2, keep=("label",), fetch=("body",)).orderBy("rank").collect()
    assert [(r.id, r.label, r.body) for r in got] == [(19, 1, "text 19"), (18, 0, "text 18")]


def test_plan_limits_early_and_shuffles_no_vector(spark):
    items, queries = random_case(0, n=50)
    text = plan(search.top_k(*tables(spark, items, queries), by=BY))
    assert text.count("WindowGroupLimit") == 2
    after = text[:text.index("MapInArrow")]
    assert "vector" not in after
    stored_parts = plan(search.top_k(*tables(spark, items, queries), by=BY, max_sent_queries=2))
    assert "vector" not in stored_parts and "WindowGroupLimit" in stored_parts
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_only_asked_groups_are_read(spark, tmp_path):
    items, queries = random_case(0, n=50)
    left, _ = tables(spark, items, queries)
    left.write.partitionBy("approach_id", "type").parquet(str(tmp_path / "v"))
    only = spark.createDataFrame([r for r in queries if r[0] == "a2"], "approach_id string, type string, query_id string, vector array<float>")
    text = plan(search.top_k(spark.read.parquet(str(tmp_path / "v")), only, by=BY))
    filters = re.search(r"PartitionFilters: \[.*?\]", text).group()
    assert "a2" in filters


HITS = "approach_id string, type string, query_id string, rank int, id string, score double, page int, original_text string"


def best(spark, *rows):
    got = search.best_page(spark.createDataFrame(list(rows), HITS)).collect()
    return [(r.type, r.id, r.page, r.snippet) for r in got]


def test_best_page(spark):
    text = ("a", "text", "q", 1, "t", 0.5, 3, "some  words")
    second = ("a", "text", "q", 2, "t2", 0.4, 9, "other")
    assert best(spark, text, second, ("a", "image", "q", 1, "i", 0.6, 4, None)) == [("image", "i", 4, None)]
    assert best(spark, text, ("a", "image", "q", 1, "i", 0.5, 4, None)) == [("text", "t", 3, "some words")]
    assert best(spark, text) == [("text", "t", 3, "some words")]
    assert best(spark, ("a", "image", "q", 1, "i", -0.5, 4, None)) == [("image", "i", 4, None)]
    assert best(spark, ("a", "image", "q", 1, "i", -1.0, 4, None)) == []
    assert best(spark, ("a", "text", "q", 1, "t", -1.0, 4, "x")) == []
