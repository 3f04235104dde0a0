"""The running quality equals the batch job after every batch."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope import fixed_values as V, schemas
from folioscope.operators import votes
from folioscope.plans import approaches, judge
from folioscope.sources import evaluations, versions
from folioscope.streaming import quality

IDS = list(votes.ALL_APPROACHES)


def log(spark, rows):
    """(approach, query, result, relevant) as votes."""
    full = [("t", "u", a, q, r, "text", 1, 0.5, V.VOTE_RELEVANT if yes else V.VOTE_NOT_RELEVANT) for a, q, r, yes in rows]
    return spark.createDataFrame(full, schemas.EVALUATION)


def table(df):
    return sorted((r.approach_id, round(r.precision, 6), round(r.recall, 6), round(r.f1, 6), r.queries) for r in df.collect())


def test_later_votes_correct_what_was_counted(spark, tmp_path):
    """Nothing relevant at first, then results turn relevant, then other approaches return them, then repeats, then nothing."""
    draw = random.Random(2)
    any_vote = lambda yes: (draw.choice(IDS + ["other"]), f"q{min(draw.randrange(12), 5)}", f"r{draw.randrange(9)}", yes)
    first = [any_vote(False) for _ in range(60)]
    batches = [first, [any_vote(draw.random() < 0.3) for _ in range(60)], first[:20], [(IDS[0], "q0", "r0", True)] * 50 + [(IDS[1], None, "r0", True), (None, "q9", None, True), (IDS[2], "q9", None, False)]]
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    own, registry = quality.session(spark, 3), approaches.registry_table(spark)
    for number, rows in enumerate(batches):
        evaluations.append(log(spark, rows), folder)
        quality.write(evaluations.read_stream(own, folder), out, mark).awaitTermination()
        assert table(quality.read(spark, out, registry)) == table(judge.quality(evaluations.read(spark, folder), registry)), number
    assert versions.runs(spark, out) == [f"{mark}#{len(batches) - 1}"]


def test_a_repeated_batch_changes_nothing(spark, tmp_path, monkeypatch):
    """The commit is made, then the job dies before the stream knows."""
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    own, registry = quality.session(spark, 2), approaches.registry_table(spark)
    evaluations.append(log(spark, [(IDS[0], "q", "r1", True), (IDS[0], "q", "r2", False), (IDS[1], "q", "r2", False)]), folder)
    with monkeypatch.context() as dying:
        dying.setattr(versions, "clean_up", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(Exception, match="gone"):
            quality.write(evaluations.read_stream(own, folder), out, mark).awaitTermination()
    before = table(quality.read(spark, out, registry))
    quality.write(evaluations.read_stream(own, folder), out, mark).awaitTermination()
    assert table(quality.read(spark, out, registry)) == before == table(judge.quality(evaluations.read(spark, folder), registry))


def test_an_empty_log(spark, tmp_path):
    registry = approaches.registry_table(spark)
    assert [r.queries for r in quality.read(spark, str(tmp_path / "none"), registry).collect()] == [0] * 4
