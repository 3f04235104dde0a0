"""Resume through filters: the same rows as the exact join, few folders opened, repeats change nothing."""

import re
import tempfile

from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.operators import corpus
from folioscope.sources import annotations, done_keys, versions
from tests.conftest import plan


def rows(spark, keys):
    return spark.createDataFrame([(d, i, p, "text", None, "o", "d", "k") for d, i, p in keys], schemas.ANNOTATION)


def blocks(spark, keys):
    return spark.createDataFrame([(d, i, p, "t") for d, i, p in keys], "doc_id string, id string, page int, text string")


def keys(documents, pages, each=2):
    return [(d, f"p{p}_txt_{b}", p) for d in documents for p in pages for b in range(each)]


def test_resume_equals_the_exact_join(spark, tmp_path):
    path = str(tmp_path / "store")
    asked = blocks(spark, keys(["a", "b", None], range(0, 300, 7)) + [("c", None, None), ("a", "p7_txt_0", None)])
    assert annotations.not_done(asked, path).count() == asked.count()
    annotations.append(rows(spark, keys(["a"], range(0, 150, 7)) + keys([None], range(0, 80, 7), 1)), path)
    annotations.append(rows(spark, keys(["a", "b"], range(140, 220, 7), 1) + [("", "p0_txt_0", 0)]), path)
    as_set = lambda df: sorted(map(str, df.select("doc_id", "id", "page").collect()))
    want = as_set(corpus.not_done(asked.filter("page is not null"), annotations.read(spark, path)))
    assert as_set(annotations.not_done(asked.filter("page is not null"), path)) == want
    annotations.compact(spark, path)
    versions.clean_up(spark, path, keep=1)
    assert len(versions.beside(spark, path)) == 1
    assert as_set(annotations.not_done(asked.filter("page is not null"), path)) == want


def test_only_folders_of_the_batch_are_opened(spark, tmp_path):
    path = str(tmp_path / "store")
    annotations.append(rows(spark, keys("abcdefgh", range(0, 1000, 50))), path)
    filters = spark.read.schema(done_keys.SCHEMA).parquet(*versions.beside(spark, path))
    again = blocks(spark, keys(["a"], range(0, 60, 50)))
    parts = done_keys.parts_to_open(again, filters)
    assert parts == [r[0] for r in again.select(done_keys.part().alias("p")).distinct().orderBy("p").collect()] and len(parts) == 1
    left = annotations.not_done(again, path)
    assert left.count() == 0
    assert re.search(rf"PartitionFilters: \[[^]]*part#\d+ = {parts[0]}\)", plan(left))
    new = blocks(spark, [("a", f"p{p}_txt_9", p) for p in range(0, 1000, 50)])
    assert done_keys.parts_to_open(new, filters) == []
    assert "Join" not in plan(annotations.not_done(new, path))


def test_filters_never_miss_and_seldom_err(spark):
    some = spark.range(20_000).select(F.lit("d").alias("doc_id"), F.col("id").cast("string").alias("id"), (F.col("id") % 50).cast("int").alias("page"))
    first, second = some.filter("id % 4 = 0"), some.filter("id % 4 = 1 AND cast(id AS int) < 200")
    made = []
    for k, part in enumerate((first, second)):
        path = tempfile.mkdtemp() + f"/{k}"
        done_keys.write(part, path)
        made.append(path)
    filters = spark.read.schema(done_keys.SCHEMA).parquet(*made)
    sizes = sorted({r[0] for r in filters.select("size").collect()})
    assert len(sizes) == 2 and sizes[0] == 1
    merged = done_keys.merged(filters)
    test = done_keys._hashed(some).withColumn("place", F.pmod("h", F.lit(sizes[1])).cast("int")).join(merged.drop("size"), ["part", "place"])
    hit = F.forall("positions", lambda p: done_keys._is_set(F.col("bits"), p))
    got = test.select(hit.alias("hit")).filter("hit").count()
    true = first.count() + second.count()
    assert true <= got <= true + 30


def test_a_repeated_append(spark, tmp_path):
    path = str(tmp_path / "store")
    for _ in range(2):
        annotations.append(rows(spark, keys(["a"], [1])), path, run="r")
    assert annotations.read(spark, path).count() == 2


def test_an_append_of_many_tasks_leaves_few_files(spark, tmp_path):
    """A part is written by one task, whatever number of tasks answered, and the filter is of the rows that were written."""
    path = str(tmp_path / "store")
    many = rows(spark, keys(["a", "b"], range(0, 2000, 5))).repartition(40)
    annotations.append(many, path)
    parts = many.select(done_keys.part()).distinct().count()
    assert parts > 20
    assert len(list((tmp_path / "store").glob("version=*/part=*/*.parquet"))) <= 2 * parts
    assert annotations.read(spark, path).count() == many.count()
    assert annotations.not_done(blocks(spark, keys(["a", "b"], range(0, 2000, 5))), path).isEmpty()
