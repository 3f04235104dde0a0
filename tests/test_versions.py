"""Replace and append in one step: crashes, repeats, readers, other writers."""

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.sources import annotations, evaluations, records, vectors, versions

SCHEMA = "x int, g string"


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def held(spark, path, **more):
    return sorted(map(tuple, versions.read(spark, path, table(spark).schema, **more).collect()))


def failing(df):
    """The rows of ``df``, of which one cannot be written."""
    def fail(x):
        if x == 13:
            raise ValueError("lost")
        return x

    return df.withColumn("x", F.udf(fail, "int")("x"))


def test_a_failed_replace_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.replace(table(spark, (1, "a"), (2, "b")), path)
    with pytest.raises(PythonException):
        versions.replace(failing(table(spark, (3, "a"), (13, "b"))), path)
    assert held(spark, path) == [(1, "a"), (2, "b")]


def test_a_crash_between_write_and_commit(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.replace(table(spark, (1, "a")), path, run="r1")
    with monkeypatch.context() as broken:
        broken.setattr(versions._Folder, "put", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            versions.replace(table(spark, (2, "a")), path, run="r2")
    assert held(spark, path) == [(1, "a")] and versions.runs(spark, path) == ["r1"]
    for _ in range(2):
        assert versions.replace(table(spark, (2, "a")), path, run="r2") == 2
    assert held(spark, path) == [(2, "a")]
    assert held(spark, path, commit=1) == [(1, "a")]
    versions.clean_up(spark, path, keep=1)
    assert held(spark, path) == [(2, "a")] and len(list((tmp_path / "t").glob("version=*"))) == 1


def test_a_reader_keeps_its_version(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.replace(table(spark, (1, "a")), path)
    before = versions.read(spark, path, table(spark).schema)
    versions.replace(table(spark, (2, "a")), path)
    assert [r.x for r in before.collect()] == [1]


def test_two_writers(spark, tmp_path, monkeypatch):
    """The second to commit adds to what the first left."""
    path, own = str(tmp_path / "t"), versions._written

    def interrupted(df, *where):
        own(df, *where)
        monkeypatch.setattr(versions, "_written", own)
        versions.append(table(spark, (1, "a")), path, run="other")

    monkeypatch.setattr(versions, "_written", interrupted)
    assert versions.append(table(spark, (2, "b")), path, run="mine") == 2
    assert held(spark, path) == [(1, "a"), (2, "b")] and versions.runs(spark, path) == ["other", "mine"]


def test_groups(spark, tmp_path):
    path = str(tmp_path / "t")
    assert held(spark, path) == []
    versions.append(table(spark, (1, "a"), (2, "b"), (3, None)), path)
    versions.replace_groups(table(spark, (4, "a")), path, "g", ["a"], partition_by=("g",))
    versions.replace_groups(table(spark, (5, "a"), (6, "c")), path, "g", ["a", "c"], partition_by=("g",))
    assert sorted(held(spark, path, column="g"), key=str) == sorted([(2, "b"), (3, None), (5, "a"), (6, "c")], key=str)
    versions.replace_groups(table(spark), path, "g", ["a"])
    assert sorted(r[0] for r in held(spark, path, column="g")) == [2, 3, 6]


def test_each_job_twice_under_one_key(spark, tmp_path):
    p = lambda name: str(tmp_path / name)
    file_rows = spark.createDataFrame([("a", 1, "text", None, "two\nlines", "d", "k")], schemas.ANNOTATION_FILE)
    vote = spark.createDataFrame([("t", "u", "a", "q", "r", "text", 1, 0.5, "relevante")], schemas.EVALUATION)
    record = spark.createDataFrame([("q", "t", "1", "s", [("u", 1)])], schemas.RATING_RECORD)
    item = spark.createDataFrame([("d", "i", 1, None, "o", "d", "k", "e", [1.0], "a1", "text")], schemas.VECTOR_ITEM)
    jobs = {
        "csv": (lambda run: annotations.write_csv(file_rows, p("csv"), run), lambda: annotations.read_csv(spark, p("csv"))),
        "store": (lambda run: annotations.append(file_rows, p("store"), run), lambda: annotations.read(spark, p("store"))),
        "log": (lambda run: evaluations.append(vote, p("log"), run), lambda: evaluations.read(spark, p("log"))),
        "records": (lambda run: records.append(record, p("records"), run), lambda: records.read(spark, p("records"))),
        "vectors": (lambda run: vectors.write(item, p("vectors"), run), lambda: vectors.read(spark, p("vectors"))),
    }
    for name, (write, read) in jobs.items():
        for run in ("monday", "monday", "tue/sday", "tue/sday"):
            write(run)
        rows = list(map(str, read().collect()))
        assert len(rows) == 2 and len(set(rows)) == 1, name


def test_what_a_crash_left_is_written_anew(spark, tmp_path):
    path = str(tmp_path / "records")
    row = lambda q: spark.createDataFrame([(q, "t", "1", "s", [])], schemas.RATING_RECORD)
    row("half").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").json(path + "/run=first")
    records.create_if_absent(row("whole"), path)
    records.create_if_absent(row("again"), path)
    assert [r["query"] for r in records.read(spark, path).collect()] == ["whole"]
