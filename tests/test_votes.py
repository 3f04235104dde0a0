import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioscope.operators import votes
from folioscope.plans import approaches, judge
from folioscope.session import stored
from tests.conftest import plan

IDS = list(votes.ALL_APPROACHES)
SCHEMA = "approach_id string, query string, result_id string, evaluation string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def by_hand(rows):
    truth = defaultdict(set)
    for a, q, r, e in rows:
        if e == "relevante" and q is not None:
            truth[q].add(r)
    got = defaultdict(set)
    for a, q, r, e in rows:
        got[a, q].add(r)
    per_query, macro = {}, {}
    for a in IDS:
        own = []
        for q, wanted in truth.items():
            found = got.get((a, q), set())
            if found:
                tp = len(found & wanted)
                p, r = tp / len(found), tp / len(wanted)
                f = 2 * p * r / (p + r) if p + r else 0.0
                per_query[a, q] = (tp, len(found) - tp, len(wanted) - tp)
                own.append((p, r, f))
        macro[a] = tuple(sum(x) / len(own) for x in zip(*own)) if own else (0.0, 0.0, 0.0)
    return per_query, macro


@pytest.mark.parametrize("seed", range(3))
def test_metrics_match_sets(spark, seed):
    rng = random.Random(seed)
    pick = [*IDS[:3], "approach_x", None]
    rows = [(rng.choice(pick), rng.choice(["q1", "q1", "q2", "q3", None]), rng.choice(["a", "b", "c", "d", "e", None]),
             rng.choice(["relevante", "nao_relevante", "nao_relevante", None, "?"])) for _ in range(120)]
    rows += [(IDS[0], "q_none", "a", "nao_relevante")]
    per_query, macro = by_hand(rows)
    table = frame(spark, rows)
    got = {(r.approach_id, r["query"]): (r.tp, r.fp, r.fn) for r in votes.confusion(table).collect()}
    assert got == per_query
    for r in judge.quality(table, approaches.registry_table(spark)).collect():
        assert (r.precision, r.recall, r.f1) == pytest.approx(macro[r.approach_id])
    fp = defaultdict(int)
    for r in votes.false_positives(table).collect():
        fp[r.approach_id, r["query"]] += 1
    fn = defaultdict(int)
    for r in votes.false_negatives(table).collect():
        fn[r.approach_id, r["query"]] += 1
    assert all(fp[k] == v[1] and fn[k] == v[2] for k, v in per_query.items())
    assert sum(fp.values()) == sum(v[1] for v in per_query.values())


def test_one_relevant_vote_is_enough_and_truth_is_pooled(spark):
    rows = [(IDS[0], "q", "r", "relevante"), (IDS[1], "q", "r", "nao_relevante"), (IDS[1], "q", "r", "nao_relevante")]
    table = frame(spark, rows)
    assert votes.truth_size(table).collect()[0].relevant == 1
    assert {r.approach_id: r.tp for r in votes.confusion(table).collect()} == {IDS[0]: 1, IDS[1]: 1}


def test_an_approach_without_queries_gets_zero(spark):
    table = frame(spark, [(IDS[0], "q", "r", "relevante")])
    rows = {r.approach_id: r for r in judge.report(table, approaches.registry_table(spark)).collect()}
    assert rows[IDS[0]].precision_text == "100.00%" and rows[IDS[0]].f1_text == "1.000"
    assert (rows[IDS[3]].precision, rows[IDS[3]].recall, rows[IDS[3]].f1_text) == (0.0, 0.0, "0.000")


def test_f1_is_the_mean_of_query_f1(spark):
    rows = [(IDS[0], "q1", "a", "relevante"), (IDS[0], "q2", "b", "nao_relevante"), (IDS[1], "q2", "c", "relevante")]
    row = judge.quality(frame(spark, rows), approaches.registry_table(spark)).filter(F.col("approach_id") == IDS[0]).first()
    assert (row.precision, row.recall, row.f1, row.queries) == (0.5, 0.5, 0.5, 2)


def test_labels(spark):
    got = votes.labelled(frame(spark, [("a", "q", "r", e) for e in ("relevante", "nao_relevante", None, "x")]))
    assert [r.is_relevant for r in got.collect()] == [1, 0, 0, 0]


def test_guards(spark):
    df = spark.createDataFrame([("", "q"), (" ", "q"), ("e", ""), ("e", " ")], "evaluator string, query string")
    assert votes.storable(df).count() == 3 and votes.askable(df).count() == 3


def test_events(spark):
    hits = spark.createDataFrame([("a", "q", "text", 1, "r1", 0.5, 3), ("a", "q", "image", 1, "r2", 0.4, 4)],
                                 "approach_id string, query string, type string, rank int, id string, score double, page int")
    thumbs = spark.createDataFrame([("ana", "a", "q", "r1", True), ("", "a", "q", "r2", True), ("ana", "a", "q", "r2", False),
                                    ("ana", "a", "q", "unknown", True)],
                                   "evaluator string, approach_id string, query string, result_id string, liked boolean")
    for shown in (hits, stored(hits)):
        rows = votes.events(shown, thumbs).collect()
        got = sorted((r.evaluator, r.result_id, r.result_type, r.result_page, r.result_score, r.evaluation) for r in rows)
        assert got == [("ana", "r1", "text", 3, 0.5, "relevante"), ("ana", "r2", "image", 4, 0.4, "nao_relevante")]
        assert all("T" in r.timestamp for r in rows)


def test_confusion_needs_two_shuffles_and_no_join(spark):
    text = plan(votes.confusion(frame(spark, [("a", "q", "r", "relevante")])))
    assert text.count("Exchange") == 2 and "Join" not in text and "Window" not in text
