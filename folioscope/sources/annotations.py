"""Annotation tables: CSV exchange and the Parquet store.

CSV is the exchange format; jobs read the Parquet store, whose rows lie in folders by part (``done_keys``).
"""

from pyspark.sql import DataFrame, functions as F

from .. import schemas
from ..operators import corpus
from . import csv_ranges, done_keys, files, versions


def with_document(df: DataFrame) -> DataFrame:
    """Rows of one unnamed document get a null ``doc_id``."""
    return df if "doc_id" in df.columns else df.withColumn("doc_id", F.lit(None).cast("string"))


def read_csv(spark, path, doc_id=None) -> DataFrame:
    """The rows of the document ``doc_id``. Header, UTF-8 with or without BOM, quoted line
    breaks, doubled quotes.

    An empty field is null, quoted or not. Page numbers such as ``3.0`` (an integer column that once held a gap) are read too.
    A large file is read by many tasks (``csv_ranges``).
    """
    df = csv_ranges.read(spark, path, schemas.ANNOTATION_FILE)
    return df.select(F.lit(doc_id).cast("string").alias("doc_id"), *df.columns) \
        .withColumn("page", F.col("page").try_cast("double").cast("int"))


CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path, run=None):
    """Add rows, once per run key. Each part file carries the header, so the folder reads back as one table."""
    files.append_run(df.select(*schemas.ANNOTATION_FILE.fieldNames()), path, lambda writer, folder: writer.csv(folder), run, **CSV)


def append(df: DataFrame, path, run=None, beside=None):
    """Add rows to the store, once per run key, with a filter of their keys beside them."""
    rows = with_document(df).select(*schemas.ANNOTATION.fieldNames()).withColumn("doc_id", F.col("doc_id").cast("string"))
    versions.append(_by_part(rows), path, run, ("part",), beside or _key_filter)


def _key_filter(written, folder):
    done_keys.write(written.select("doc_id", "id", "page"), folder)


def _by_part(rows):
    """Rows of a part in one task, of a large one in a few: else each task leaves a file in every part."""
    return rows.withColumn("part", done_keys.part()).hint("rebalance", "part")


def read(spark, path, where=None) -> DataFrame:
    """The store; a store that was never written is an empty table."""
    return versions.read(spark, path, schemas.ANNOTATION, where=where)


def not_done(candidates: DataFrame, path) -> DataFrame:
    """Candidates (doc_id, id, page and more) without an annotation in the store.

    The filters beside the store tell which parts can hold one of them. Only the folders of these parts are
    opened, for an exact comparison; where there are none, nothing is joined.
    """
    spark = candidates.sparkSession
    filters = versions.beside(spark, path)
    if not filters:
        return candidates
    keys = with_document(candidates).select("doc_id", "id", "page")
    parts = done_keys.parts_to_open(keys, spark.read.schema(done_keys.SCHEMA).parquet(*filters))
    if not parts:
        return candidates
    done = read(spark, path, F.col("part").isin(parts)).select("doc_id", "id")
    if "doc_id" not in candidates.columns:
        return corpus.not_done(with_document(candidates), done).drop("doc_id")
    return corpus.not_done(candidates, done)


def compact(spark, path):
    """Many small appends become one folder with one filter; the rows stay the same."""
    rows = read(spark, path)
    versions.replace(_by_part(rows), path, None, ("part",), _key_filter)


def replace_clean(df: DataFrame, path, run=None):
    """The clean table takes the place of the old one in one step; a write that fails leaves the old one."""
    versions.replace(df, path, run)


def read_clean(spark, path, schema) -> DataFrame:
    return versions.read(spark, path, schema)


def append_counted(df: DataFrame, path):
    """Append and return the number of rows, counted in what was written."""
    seen = []

    def counted(written, folder):
        _key_filter(written, folder)
        seen.append(written.count())

    append(df, path, beside=counted)
    return seen[-1]
