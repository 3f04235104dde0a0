"""Rating records: flatten the nested responses and summarise them."""

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..sources.pages import relative_path
from . import skew


def flatten(records: DataFrame, users: DataFrame) -> DataFrame:
    """One row per response with the rater's name; a record without responses stays as a
    pending row. ``value`` is null exactly there; ``relevancia`` is its display form.

    Pending rows have no user. They get spread-out join keys that match nobody, so that
    a mostly unrated data set does not meet in one task. The ratings of a busy rater are not shuffled.
    """
    fields = [c for c in records.columns if c != "responses"]
    rows = records.select(*fields, F.explode_outer("responses").alias("response")).select(
        *fields, F.col("response").isNotNull().alias("rated"),
        F.col("response.user_id").alias("user_id"), F.col("response.value").alias("value"),
    )
    nobody = F.concat(F.lit("\u0000"), F.xxhash64(*fields))
    rows = rows.withColumn("user_key", F.coalesce(F.col("user_id").cast("string"), nobody))
    names = users.select(F.col("id").cast("string").alias("user_key"), "username")
    return skew.join(rows, names, ["user_key"], "left").select(
        *fields,
        F.when(F.col("rated"), F.col("username")).otherwise(V.NO_USER).alias("user"),
        "value",
        F.when(F.col("rated"), F.col("value").cast("string")).otherwise(V.PENDING).alias("relevancia"),
    )


def completed(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("value").isNotNull())


def _responses(records):
    return records.select(F.explode("responses").alias("r")).select("r.user_id", "r.value")


def split_domain(rows: DataFrame, allowed=V.RATING_VALUES, value="value"):
    """Ratings with an allowed value, and all others; together they are the input."""
    ok = F.coalesce(F.col(value).isin(list(allowed)), F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def overall(records: DataFrame) -> DataFrame:
    """Precision over all completed ratings and their number. Names are not needed, so
    nothing is joined."""
    return completed(_responses(records)).agg(
        F.avg("value").alias("precision"), F.count("value").alias("ratings")
    )


def by_user(records: DataFrame, users: DataFrame) -> DataFrame:
    """Mean and count per rater name.

    Ratings are summed per id before the join, so a busy rater is one row in it.
    """
    per_id = completed(_responses(records)).groupBy("user_id").agg(
        F.sum("value").alias("total"), F.count("value").alias("n")
    )
    names = users.select(F.col("id").alias("user_id"), F.col("username").alias("user"))
    return (
        per_id.join(names, "user_id", "left")
        .groupBy("user")
        .agg((F.sum("total") / F.sum("n")).alias("precision"), F.sum("n").alias("ratings"))
    )


def text_records(hits: DataFrame, query="query", text="text_for_embedding") -> DataFrame:
    """Records for judging text results, with an empty response list."""
    return hits.select(
        F.col(query).alias("query"), F.col(text).alias("result_text"),
        F.format_string(V.PAGE_LABEL, F.col("page").cast("int")).alias("page"),
        F.format_string(V.SCORE_LABEL, F.col("score")).alias("score"),
    )


def image_html(content) -> Column:
    """Image bytes as an inline tag, or a note where there are none. The bytes are used
    as they are stored; nothing is re-encoded."""
    content = F.col(content) if isinstance(content, str) else content
    body = F.translate(F.base64(content), "\r\n", "")
    return F.coalesce(
        F.concat(F.lit(V.IMAGE_TAG_HEAD), body, F.lit(V.IMAGE_TAG_TAIL)),
        F.lit(V.IMAGE_MISSING),
    )


def multimodal_records(hits: DataFrame, images: DataFrame, query="query",
                       text="text_for_embedding", root="") -> DataFrame:
    """Records for judging text and image results in one list.

    ``images`` is ``(content_path, content)``; paths are compared below ``root``. Give hits that are a table
    (``session.stored``): then the paths of a small one are broadcast, and only the
    bytes of images that were hit get past the scan.
    """
    images = images.withColumn("content_path", relative_path("content_path", root))
    labels = V.TYPE_LABELS
    texts = hits.filter(F.col("type") == "text").select(
        F.col(query).alias("query"), F.lit(labels["text"]).alias("type"),
        F.col(text).alias("content"),
    )
    shown = hits.filter(F.col("type") == "image").select(
        query, relative_path("content_path", root).alias("content_path"), text)
    paths = shown.select("content_path").distinct()
    needed = images.join(paths, "content_path", "left_semi")
    pictures = shown.join(needed, "content_path", "left").select(
        F.col(query).alias("query"), F.lit(labels["image"]).alias("type"),
        F.concat(image_html("content"), F.lit(V.IMAGE_CAPTION), F.col(text)).alias("content"),
    )
    return texts.unionByName(pictures)
