"""Incremental annotate: a stream of pages or images, only what is new is annotated.

What failed is kept beside the store and asked again with the next batch, and when the
job starts; an annotation in the store ends it. The table of failures holds what failed last
time and nothing else: each batch replaces it in one step.
"""

from pyspark.sql import DataFrame, functions as F, types as T

from ..operators import corpus, images as image_filter
from ..plans import annotate
from ..session import stored
from ..sources import annotations as store, versions

KEY = ["doc_id", "id"]
FAILED_TEXT = T.StructType([T.StructField(n, T.IntegerType() if n == "page" else T.StringType()) for n in (*KEY, "page", "text")])
FAILED_IMAGE = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("id", T.StringType()), T.StructField("page", T.IntegerType()),
    T.StructField("content_path", T.StringType()), T.StructField("image", T.StructType([T.StructField("data", T.BinaryType())]))])


def failed_path(path, kind="text"):
    return path.rstrip("/") + {"text": "-failed", "image": "-failed-images"}[kind]


def failed(spark, path, kind="text") -> DataFrame:
    """What was asked about and has no annotation, once each."""
    schema = {"text": FAILED_TEXT, "image": FAILED_IMAGE}[kind]
    return store.not_done(versions.read(spark, failed_path(path, kind), schema).dropDuplicates(KEY), path)


def _asked(todo, path, kind, ask, annotations):
    """Ask, keep the answers, and let what failed now take the place of what failed before."""
    schema = {"text": FAILED_TEXT, "image": FAILED_IMAGE}[kind]
    answered = stored(ask(todo), "answered")
    store.append(annotations(answered), path)
    columns = [F.struct(F.col("image.data").alias("data")).alias("image") if n == "image" else F.col(n) for n in schema.fieldNames()]
    versions.replace(answered.filter(F.col("error").isNotNull()).select(*columns), failed_path(path, kind))
    versions.clean_up(todo.sparkSession, failed_path(path, kind))


def _keyed(rows):
    return rows.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("page", F.col("page").cast("int"))


def _ask_texts(make_annotate, rows_per_task):
    return lambda todo: annotate.ask(todo, make_annotate, rows_per_task)


def annotate_batch(batch: DataFrame, path, make_annotate, mode="relevant", phrases=None,
                   rows_per_task=annotate.ROWS_PER_TASK):
    """Annotate the new blocks of a batch and those that failed before. Of the store only the parts are
    opened that may hold a block of the batch."""
    blocks = corpus.keep_texts(corpus.page_blocks(store.with_document(batch)), mode, phrases=phrases)
    new = store.not_done(_keyed(blocks).select(*FAILED_TEXT.fieldNames()), path)
    todo = new.unionByName(failed(batch.sparkSession, path)).dropDuplicates(KEY)
    _asked(todo, path, "text", _ask_texts(make_annotate, rows_per_task), annotate.text_annotations)


def retry(spark, path, make_annotate, rows_per_task=annotate.ROWS_PER_TASK):
    """Ask again about what failed."""
    todo = failed(spark, path)
    if not todo.isEmpty():
        _asked(todo, path, "text", _ask_texts(make_annotate, rows_per_task), annotate.text_annotations)


def run(pages: DataFrame, path, checkpoint, make_annotate, mode="relevant", phrases=None,
        rows_per_task=annotate.ROWS_PER_TASK):
    """Annotate the blocks of a page stream, after those that an earlier run failed on. A
    repeated batch adds nothing, because its keys are already in the store."""
    retry(pages.sparkSession, path, make_annotate, rows_per_task)

    def batch(df, _):
        annotate_batch(df, path, make_annotate, mode, phrases, rows_per_task)

    return _started(pages, checkpoint, batch)


def _images_asked(todo, path, make_annotate, rows_per_task):
    def ask(rows):
        return annotate.ask_images(rows, make_annotate, rows_per_task=rows_per_task)

    _asked(todo, path, "image", ask, annotate.image_annotations)


def annotate_images(batch: DataFrame, path, make_annotate, rows_per_task=annotate.ROWS_PER_TASK, **limits):
    """The same for images; only those worth asking about are kept among the failures."""
    new = image_filter.keep_images(store.not_done(_keyed(store.with_document(batch)).dropDuplicates(KEY), path), "image", **limits)
    new = new.select(*KEY, "page", "content_path", F.struct(F.col("image.data").alias("data")).alias("image"))
    todo = new.unionByName(failed(batch.sparkSession, path, "image")).dropDuplicates(KEY)
    _images_asked(todo, path, make_annotate, rows_per_task)


def run_images(images: DataFrame, path, checkpoint, make_annotate, rows_per_task=annotate.ROWS_PER_TASK, **limits):
    """Annotate the images of a stream, after those that an earlier run failed on."""
    before = failed(images.sparkSession, path, "image")
    if not before.isEmpty():
        _images_asked(before, path, make_annotate, rows_per_task)

    def batch(df, _):
        annotate_images(df, path, make_annotate, rows_per_task, **limits)

    return _started(images, checkpoint, batch)


def _started(stream, checkpoint, batch):
    return stream.writeStream.option("checkpointLocation", checkpoint) \
        .foreachBatch(batch).trigger(availableNow=True).start()
