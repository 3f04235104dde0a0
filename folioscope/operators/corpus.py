"""From pages to annotation candidates."""

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions import text as X


def item_id(page, kind, index) -> Column:
    """``p{page}_txt_{i}`` for a text block, ``p{page}_img_{i}`` for an image."""
    return F.concat(F.lit("p"), page, F.lit(f"_{kind}_"), index)


def page_blocks(pages: DataFrame, text="text", page="page", separator="\n") -> DataFrame:
    """One row per block of a page's text, numbered from 0 before any filter.

    A narrow step: no shuffle, and the other columns of ``pages`` are kept.
    """
    pieces = F.split(F.col(text), X.literal(separator))
    return block_rows(pages.withColumn(text, pieces), blocks=text, page=page)


def block_rows(pages: DataFrame, blocks="blocks", page="page") -> DataFrame:
    """As ``page_blocks`` for pages that already hold an array of blocks."""
    others = [c for c in pages.columns if c != blocks]
    # cleaned before the explode: a filter on the text then reads it instead of
    # repeating the cleaning
    pieces = F.transform(blocks, X.one_line)
    rows = _numbered(pages.select(*others, F.posexplode_outer(pieces).alias("block_index", "text")))
    return rows.select(
        *others,
        "block_index",
        item_id(F.col(page), "txt", F.col("block_index")).alias("id"),
        "text",
    )


def _numbered(rows):
    """Drops the row an outer explode makes of an empty page. A plain explode would have
    the optimizer test the array's size first, and so split every text twice."""
    return rows.filter(F.col("block_index").isNotNull())


def image_rows(pages: DataFrame, images="images", page="page", folder="images") -> DataFrame:
    """One row per image of a page, with its id and the path its file gets."""
    others = [c for c in pages.columns if c != images]
    rows = _numbered(pages.select(*others, F.posexplode_outer(images).alias("block_index", "image")))
    rows = rows.withColumnRenamed("block_index", "image_index")
    key = item_id(F.col(page), "img", F.col("image_index"))
    return rows.select(
        *others, "image_index", key.alias("id"), "image",
        F.concat(F.lit(f"{folder}/"), key, F.lit(".png")).alias("content_path"),
    )


def keep_texts(blocks: DataFrame, mode="relevant", text="text", phrases=None,
               min_length=V.MIN_TEXT_LENGTH) -> DataFrame:
    """``relevant`` drops boilerplate, leaders and short texts; ``length_only`` is the
    older rule, which also drops a text of exactly ``min_length``."""
    col = F.col(text)
    if mode == "relevant":
        return blocks.filter(X.is_relevant(col, phrases, min_length))
    if mode == "length_only":
        return blocks.filter(X.longer_than(col, min_length))
    raise ValueError(f"unknown filter mode: {mode}")


def not_done(candidates: DataFrame, done: DataFrame, keys=None) -> DataFrame:
    """Candidates without an annotation.

    Ids are unique within one document: where both sides have a ``doc_id`` it is part of the
    key, and an unnamed document is one, too.
    """
    if keys is None:
        keys = ("doc_id", "id") if "doc_id" in candidates.columns and "doc_id" in done.columns else ("id",)
    other = done.select(*[F.col(c).alias(f"_{c}") for c in keys])
    same = F.col("id") == F.col("_id") if "id" in keys else F.lit(True)
    for c in keys:
        if c != "id":
            same = same & F.col(c).cast("string").eqNullSafe(F.col(f"_{c}").cast("string"))
    return candidates.join(other, same, "left_anti")


def prompts(blocks: DataFrame, text="text", template=V.TEXT_PROMPT) -> DataFrame:
    """The model input per block."""
    return blocks.withColumn("prompt", F.replace(F.lit(template), F.lit("{}"), F.col(text)))


def image_prompts(images: DataFrame, template=V.IMAGE_PROMPT) -> DataFrame:
    return images.withColumn("prompt", F.lit(template))


def parse_answers(answers: DataFrame, answer="answer") -> DataFrame:
    return answers.withColumn("description_llm", X.answer_summary(answer)).withColumn(
        "keywords_llm", X.answer_keywords(answer)
    )


def clean(annotations: DataFrame, null_words=None) -> DataFrame:
    """Null words become null, rows without description or keywords go, types are cast."""
    out = annotations
    for name in annotations.columns:
        if name in ("content_path", "original_text", "description_llm", "keywords_llm"):
            out = out.withColumn(name, X.null_words_to_null(name, null_words))
    return (
        out.dropna(subset=["description_llm", "keywords_llm"])
        .withColumn("keywords_llm", F.col("keywords_llm").cast("string"))
        .withColumn("page", F.col("page").cast("int"))
    )


def of_type(items: DataFrame, *kinds) -> DataFrame:
    """The items of one type, or of several in one scan."""
    return items.filter(F.col("type").isin(list(kinds)))
