"""The annotate job: pages and images to annotations, with resume and an injected annotator."""

from typing import Iterator, Tuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from ..operators import corpus, images as image_filter
from ..session import stored
from ..sources import annotations as store

ROWS_PER_TASK = 500  # prompts a task asks; a model call takes far longer than a row


def answer(prompts: DataFrame, make_annotate, prompt="prompt", image=None) -> DataFrame:
    """Adds ``answer`` and ``error``.

    ``make_annotate`` runs once per task and returns ``annotate(prompt) -> text``, or
    ``annotate(prompt, image bytes) -> text`` where ``image`` names a column of bytes. An
    exception is caught per row: its text goes to ``error`` and the row can be tried
    again in the next run. Only prompts and images go to Python, and each is asked once: the
    call is declared nondeterministic, so the optimizer makes no copies of it.
    """
    def asked_rows(annotate, rows):
        def one(*values):
            try:
                text = annotate(*values)
                if not isinstance(text, str):
                    raise TypeError(f"answer is {type(text).__name__}, not text")
                return text, None
            except Exception as problem:
                return None, f"{type(problem).__name__}: {problem}"

        return pd.DataFrame([one(*v) for v in rows], columns=["answer", "error"])

    def ask_texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        annotate = make_annotate()
        for batch in batches:
            yield asked_rows(annotate, zip(batch))

    def ask_images(batches: Iterator[Tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        annotate = make_annotate()
        for texts, files in batches:
            yield asked_rows(annotate, zip(texts, files))

    call = ask_texts if image is None else ask_images
    asked = F.pandas_udf(call, "answer string, error string").asNondeterministic()
    inputs = [prompt] if image is None else [prompt, image]
    return prompts.withColumn("_asked", asked(*inputs)).select(*prompts.columns, "_asked.answer", "_asked.error")


def _annotations(answered, kind, path, text):
    ok = corpus.parse_answers(store.with_document(answered).filter(F.col("error").isNull()))
    return ok.select(
        F.col("doc_id").cast("string").alias("doc_id"), "id", F.col("page").cast("int").alias("page"),
        F.lit(kind).alias("type"), path.alias("content_path"), text.alias("original_text"),
        "description_llm", "keywords_llm",
    )


def text_annotations(answered: DataFrame) -> DataFrame:
    """Annotation rows from answered text blocks; rows with an error are left out."""
    return _annotations(answered, "text", F.lit(None).cast("string"), F.col("text"))


def image_annotations(answered: DataFrame) -> DataFrame:
    return _annotations(answered, "image", F.col("content_path"), F.lit(None).cast("string"))


def spread_rows(todo: DataFrame, rows_per_task=ROWS_PER_TASK) -> DataFrame:
    """``todo`` as a table, dealt out by id in tasks of about ``rows_per_task`` rows: model
    calls dominate, however few bytes the rows have."""
    todo = stored(todo, "todo")
    return todo.repartition(max(1, -(-todo.count() // rows_per_task)), "id")


def ask(candidates: DataFrame, make_annotate, rows_per_task=ROWS_PER_TASK) -> DataFrame:
    """Prompts and answers for text blocks."""
    return answer(corpus.prompts(spread_rows(candidates, rows_per_task)), make_annotate)


def ask_images(candidates: DataFrame, make_annotate, image="image.data", rows_per_task=ROWS_PER_TASK) -> DataFrame:
    """Prompts and answers for images; the annotator gets the prompt and the bytes in ``image``."""
    rows = spread_rows(candidates, rows_per_task).withColumn("_bytes", F.col(image))
    return answer(corpus.image_prompts(rows), make_annotate, image="_bytes").drop("_bytes")


def _finish(answered, rows, path):
    """The answers are stored: neither the append nor the failure count calls the
    model again, and an executor lost later cannot repeat calls that were paid for."""
    answered = stored(answered, "answered")
    added = store.append_counted(rows(answered), path)
    return added, answered.filter(F.col("error").isNotNull()).count()


def run(pages: DataFrame, path, make_annotate, mode="relevant", phrases=None, rows_per_task=ROWS_PER_TASK):
    """Annotate what is missing in the store at ``path``; returns rows added and failed."""
    blocks = corpus.keep_texts(corpus.page_blocks(pages), mode, phrases=phrases)
    todo = store.not_done(blocks, path)
    return _finish(ask(todo, make_annotate, rows_per_task), text_annotations, path)


def run_images(images: DataFrame, path, make_annotate, rows_per_task=ROWS_PER_TASK, **limits):
    """The same for images: (doc_id, id, page, content_path, image), the image decoded as Spark's
    image source does it. Small and one-coloured images are not asked about."""
    todo = image_filter.keep_images(store.not_done(images, path), "image", **limits)
    return _finish(ask_images(todo, make_annotate, rows_per_task=rows_per_task), image_annotations, path)
