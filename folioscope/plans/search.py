"""The search job: query texts to ranked results, a page to open, and rating records."""

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from ..operators import ratings, search
from ..session import stored
from ..sources import records
from . import approaches


def fixed_queries(spark, texts=V.TEST_QUERIES) -> DataFrame:
    """The fixed queries results are judged on."""
    rows = [(f"q{i:02d}", text) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "query_id string, query string")


def answer(queries: DataFrame, items: DataFrame, encoders, registry=approaches.REGISTRY,
           k=V.TOP_K, fetch=("original_text", "description_llm", "text_for_embedding")) -> DataFrame:
    """Texts and images for every query under every approach, ranked separately.

    ``items`` is the vector store; empty queries are not searched.
    """
    vectors = approaches.query_vectors(queries, encoders, registry)
    return search.top_k(
        items, vectors, k=k, by=("approach_id", "type"), key=_document(items), keep=("page",), fetch=fetch
    )


def _document(items):
    """Ids are unique within a document, so its name is part of an item's key."""
    return ("doc_id",) if "doc_id" in items.columns else ()


def pages_to_open(queries: DataFrame, items: DataFrame, encoders,
                  registry=approaches.REGISTRY) -> DataFrame:
    """The best page per query and approach, with the snippet to mark on it."""
    first = answer(queries, items, encoders, registry, k=1, fetch=())
    return search.best_page(first, items=items, key=_document(items))


def _records(queries, items, encoders, approach_id, k, fetch, kinds):
    registry = [a for a in approaches.REGISTRY if a.approach_id == approach_id]
    vectors = approaches.query_vectors(queries, encoders, registry).filter(F.col("type").isin(kinds))
    hits = search.top_k(items, vectors, k=k, by=("approach_id", "type"), key=_document(items), keep=("page",), fetch=fetch)
    return stored(hits, "hits").join(queries, "query_id")


def text_rating_records(queries: DataFrame, items: DataFrame, encoders,
                        approach_id=V.APPROACH_TEXT_ONLY, k=V.TOP_K) -> DataFrame:
    """Records for people to rate: the best texts per query under one approach."""
    hits = _records(queries, items, encoders, approach_id, k, ("text_for_embedding",), ["text"])
    return ratings.text_records(hits)


def multimodal_rating_records(queries: DataFrame, items: DataFrame, encoders, images: DataFrame,
                              approach_id=V.APPROACH_UNIFIED, k=V.TOP_K, root="") -> DataFrame:
    """The same for texts and images, with the image itself in the record."""
    hits = _records(queries, items, encoders, approach_id, k,
                    ("text_for_embedding", "content_path"), ["text", "image"])
    return ratings.multimodal_records(hits, images, root=root)


def write_records(queries: DataFrame, items: DataFrame, encoders, path, images: DataFrame = None, root="", run=None):
    """The records job: queries to hits to a data set that people rate.

    With ``images`` the records show texts and images and are added, once per ``run`` key; without, they
    are texts, written only where there is no data set yet.
    """
    if images is None:
        records.create_if_absent(text_rating_records(queries, items, encoders), path)
    else:
        records.append(multimodal_rating_records(queries, items, encoders, images, root=root), path, run)
