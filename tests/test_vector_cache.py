"""Builds with a cache: the same vectors, each input encoded once."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from folioscope import fixed_values as V
from folioscope.functions import encoders
from folioscope.plans import approaches, vector_cache
from folioscope.sources import versions

WIDTH = 16


def models(broken=""):
    """Hashed words; an input with the word ``broken`` fails."""
    def make():
        predict = encoders.hashed_words(WIDTH)()

        def run(texts):
            texts = [bytes(t).decode() if isinstance(t, (bytes, bytearray)) else t for t in texts]
            if broken and any(broken in t for t in texts):
                raise RuntimeError("busy")
            return predict(texts)

        return run

    column = encoders.encoder(make, WIDTH)
    text = approaches.Encoder(text=column, passage_prefix=V.PASSAGE_PREFIX, query_prefix=V.QUERY_PREFIX, width=WIDTH)
    return {V.TEXT_MODEL: text, V.JOINT_MODEL: approaches.Encoder(text=column, image=column, width=WIDTH)}


def rows(spark, *more):
    """Copies, a missing file, words that no model knows, a type that takes no part."""
    all_rows = [("p1_txt_0", "text", "one two", None), ("p1_txt_1", "text", "one two", None), (None, "text", "one two", None), ("p2_txt_0", "text", "!", None),
                ("p1_img_0", "image", "a cell", b"pixels of a cell"), ("p1_img_1", "image", "a cell", None), ("t", "table", "x y", None), *more]
    return spark.createDataFrame([(i, 1, k, d, "key words", c) for i, k, d, c in all_rows],
                                 "id string, page int, type string, description_llm string, keywords_llm string, content binary")


def vectors(df):
    return sorted((r.approach_id, str(r.id), r.type, [round(float(x), 6) for x in r.vector]) for r in df.select("approach_id", "id", "type", "vector").collect())


def test_a_rebuild_equals_a_build_and_encodes_what_is_new(spark, tmp_path):
    path = str(tmp_path / "cache")
    count = lambda run: {(r.model, r.kind): r.encoded for r in vector_cache.Cache(spark, path, "").encodes().collect() if r.run == run}
    assert vectors(approaches.build(rows(spark), models(), cache=vector_cache.Cache(spark, path, "a"))) == vectors(approaches.build(rows(spark), models()))
    first = count("a")
    # three texts (two that are equal) and an image's, by two templates and models; one file
    assert first == {(V.TEXT_MODEL, "text"): 3, (V.JOINT_MODEL, "text"): 6, (V.JOINT_MODEL, "image"): 1}
    more = rows(spark, ("p3_txt_0", "text", "three four", None), ("p3_img_0", "image", "a cell", b"pixels of a cell"))
    assert vectors(approaches.build(more, models(), cache=vector_cache.Cache(spark, path, "b"))) == vectors(approaches.build(more, models()))
    assert count("a") == first and count("b") == {(V.TEXT_MODEL, "text"): 1, (V.JOINT_MODEL, "text"): 2}


def test_a_failed_encode_is_asked_again(spark, tmp_path):
    path, some = str(tmp_path / "cache"), rows(spark, ("p4_txt_0", "text", "three stumble", None))
    approaches.build(some, models("stumble"), cache=vector_cache.Cache(spark, path, "a"))
    built = approaches.build(some, models(), cache=vector_cache.Cache(spark, path, "b"))
    assert vectors(built) == vectors(approaches.build(some, models()))
    assert {r.run for r in vector_cache.Cache(spark, path, "").read().filter("kind = 'text'").collect()} == {"a", "b"}


def test_a_build_that_dies_goes_on(spark, tmp_path, monkeypatch):
    path, own, done = str(tmp_path / "cache"), versions.append, []

    def dying(df, where, run=None, **more):
        if len(done) == 1:
            raise OSError("gone")
        done.append(run)
        return own(df, where, run, **more)

    with monkeypatch.context() as broken:
        broken.setattr(versions, "append", dying)
        with pytest.raises(OSError):
            approaches.build(rows(spark), models(), cache=vector_cache.Cache(spark, path, "a"))
    kept = vector_cache.Cache(spark, path, "a").read().count()
    assert kept > 0
    assert vectors(approaches.build(rows(spark), models(), cache=vector_cache.Cache(spark, path, "a"))) == vectors(approaches.build(rows(spark), models()))
    keys = vector_cache.Cache(spark, path, "a").read().select(F.hex("key").alias("k"))
    assert keys.count() == keys.distinct().count() > kept


def test_an_empty_table(spark, tmp_path):
    assert approaches.build(rows(spark).limit(0), models(), cache=vector_cache.Cache(spark, str(tmp_path / "c"), "a")).count() == 0


def test_one_approach(spark, tmp_path):
    """Texts and images whose inputs go to one model under one template."""
    some = approaches.only(V.APPROACH_TEXT_ONLY)
    built = approaches.build(rows(spark), models(), some, cache=vector_cache.Cache(spark, str(tmp_path / "c"), "a"))
    assert vectors(built) == vectors(approaches.build(rows(spark), models(), some))


def test_rows_are_made_once(spark, tmp_path):
    """A branch computes its rows once, whatever they come from."""
    made = spark.sparkContext.accumulator(0)

    def seen(text):
        made.add(1)
        return text

    some = rows(spark)
    some = some.withColumn("description_llm", F.udf(seen, "string").asNondeterministic()("description_llm"))
    vectors(approaches.build(some, models(), cache=vector_cache.Cache(spark, str(tmp_path / "c"), "a")))
    assert made.value <= 2 * some.count()


@pytest.mark.parametrize("sent", [0, 1 << 12])
def test_many_rows(spark, tmp_path, monkeypatch, sent):
    """More inputs than a bitmap has bits, some in several rows; the bitmaps sent or not."""
    monkeypatch.setattr(vector_cache, "SENT_BITMAPS", sent)
    i = F.col("id")
    some = spark.range(0, 20_000, 1, 2).select(
        i.cast("string").alias("id"), F.lit(1).alias("page"), F.lit("text").alias("type"), F.concat(F.lit("word"), i % 15_000).alias("description_llm"),
        F.lit("key words").alias("keywords_llm"), F.lit(None).cast("binary").alias("content"))
    cache = vector_cache.Cache(spark, str(tmp_path / "c"), "a")
    assert vectors(approaches.build(some, models(), cache=cache)) == vectors(approaches.build(some, models()))
    assert {(r.model, r.encoded) for r in cache.encodes().collect()} == {(V.TEXT_MODEL, 15_000), (V.JOINT_MODEL, 30_000)}


def test_hashed_words():
    """Words parted by anything that is no word character, ASCII or not; single code points are none."""
    texts = ["", None, "One two_2 x é", "Ölfaß–über”x” b’s", "a bc de\x1cf9", "́x ½½ 中文。中", "same same"]
    got = encoders.hashed_words(WIDTH)()(texts)
    for text, row in zip(texts, got):
        want = [0] * WIDTH
        for word in re.findall(r"\w{2,}", (text or "").lower()):
            want[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % WIDTH] += 1
        assert row.tolist() == want
