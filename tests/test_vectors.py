import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions import encoders, vectors as U
from tests.conftest import plan


def unit(v):
    v = np.asarray(v, dtype=float)
    n = np.linalg.norm(v)
    return v / n if n else v


def test_normalize_and_zero(one):
    assert one(U.l2_normalize("v"), v=[3.0, 4.0]) == [0.6, 0.8]
    assert one(U.l2_normalize("v"), v=[0.0, 0.0]) == [0.0, 0.0]


def test_dot_and_norm(one):
    assert one(U.dot("a", "b"), U.norm("a"), a=[1.0, 2.0, 2.0], b=[1.0, 0.5, -1.0]) == (0.0, 3.0)


def test_fuse_has_length_one_or_zero(spark):
    rng = np.random.default_rng(0)
    rows = [(rng.normal(size=5).tolist(), rng.normal(size=5).tolist()) for _ in range(20)]
    rows += [([0.0] * 5, [0.0] * 5), ([0.0] * 5, [1.0] * 5)]
    out = spark.createDataFrame(rows, "a array<double>, b array<double>").withColumn("f", U.fuse("a", "b")).collect()
    for r in out:
        expected = unit(0.4 * unit(r.a) + 0.6 * unit(r.b))
        assert np.allclose(r.f, expected)
        assert round(float(np.linalg.norm(r.f)), 9) in (0.0, 1.0)


def test_zero_fallback(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(U.zero_if_missing("v", 2)).collect()] == [[1.0, 2.0], [0.0, 0.0]]


def failing():
    def predict(batch):
        if any(t == "bad" for t in batch):
            raise RuntimeError("no")
        return np.array([[len(t), 1.0] for t in batch])

    return predict


def test_a_failing_row_costs_only_itself(spark):
    df = spark.createDataFrame([("a",), ("bad",), ("abc",)], "t string").coalesce(1)
    out = [r[0] for r in df.select(encoders.encoder(failing, 2)("t")).collect()]
    assert out == [[1.0, 1.0], [0.0, 0.0], [3.0, 1.0]]


def test_hashed_words_counts(spark):
    df = spark.createDataFrame([("casa Casa azul",), ("",), (None,)], "t string")
    a, b, c = [r[0] for r in df.select(encoders.encoder(encoders.hashed_words(32), 32)("t")).collect()]
    assert sum(a) == 3 and max(a) >= 2 and sum(b) == 0 and sum(c) == 0


def broken():
    def predict(batch):
        raise OSError("no weights")

    return predict


def test_a_broken_model_raises(spark):
    df = spark.createDataFrame([(f"t{i}",) for i in range(40)], "t string").coalesce(1)
    with pytest.raises(Exception, match="fails on every input"):
        df.select(encoders.encoder(broken, 2)("t")).collect()
    with pytest.raises(Exception, match="no weights"):
        df.limit(1).select(encoders.encoder(broken, 2, failures="raise")("t")).collect()
    nothing = spark.createDataFrame([(None,)] * 40, "t string").coalesce(1)
    assert {tuple(r[0]) for r in nothing.select(encoders.encoder(broken, 2)("t")).collect()} == {(0.0, 0.0)}


def test_encoders_of_a_projection_share_a_worker(spark):
    """An iterator function would be a Python worker of its own, with its own Arrow batch."""
    a, b = encoders.encoder(encoders.hashed_words(8), 8), encoders.encoder(encoders.hashed_words(16), 16)
    df = spark.createDataFrame([(f"w{i} x{i} y{i % 3}" if i % 5 else None,) for i in range(700)], "t string").coalesce(1)
    both = df.select("t", a("t").alias("a"), b("t").alias("b"))
    assert plan(both).count("ArrowEvalPython") == 1
    rows = both.collect()
    narrow, wide = encoders.hashed_words(8)(), encoders.hashed_words(16)()
    assert [r.a for r in rows] == narrow([r.t for r in rows]).tolist() and [r.b for r in rows] == wide([r.t for r in rows]).tolist()
    assert spark.createDataFrame([], "t string").select(a("t")).collect() == []


def test_a_model_is_made_once_per_worker(monkeypatch):
    monkeypatch.setattr(encoders, "_models", encoders.OrderedDict())
    made = []
    for name in "aabacdeafa":
        encoders._model(name, lambda: made.append(name) or name)
    assert made == list("abcdef") and len(encoders._models) == encoders.MODELS_KEPT
