"""Inputs of the registered queries, derived from the driver's tables.

Every view uses its tables whole, and the texts in them from end to end. The DuckDB twins are in ``oracles.py``.
"""

from pyspark.sql import functions as F

from folioscope import fixed_values as V
from folioscope.functions import encoders as E
from folioscope.operators import corpus
from folioscope.plans import approaches, vector_cache
from folioscope.session import scratch_path, spread

STOP_PHRASES = ["licensed under", "all rights reserved", "copyright"]
UNBUILT = "approach_0_unbuilt"
OTHER = "approach_9_other"
IDS = [a.approach_id for a in approaches.REGISTRY]


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, sf):
    """Whole texts, on all cores: a small table is one split."""
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def page_of(d):
    """(doc_id, page): the texts are the pages of two documents, which share page numbers."""
    return F.concat(F.lit("d"), d % 2).alias("doc_id"), (F.floor(d / 2) + 1).cast("int").alias("page")


def pages(spark, sf):
    return documents(spark, sf).select(*page_of(F.col("doc_id")), "text")


def done(spark, sf):
    """Annotated blocks: every third of the first document's, every fifth of the second's."""
    rows = blocks(spark, sf).select("doc_id", "id", "page", "block_index")
    return rows.filter(F.when(F.col("doc_id") == "d0", F.col("page") % 3 == 0).otherwise(F.col("block_index") % 5 == 0))


def blocks(spark, sf):
    return corpus.page_blocks(pages(spark, sf))


def _keywords(text):
    """Every piece of the text."""
    return F.replace(text, F.lit(" "), F.lit(", "))


def annotations(spark, sf):
    d, text = F.col("doc_id"), F.col("text")
    docs = documents(spark, sf)
    page = F.floor(d / 10).cast("int") + 1
    key = F.concat(
        F.lit("p"), page, F.when(d % 3 == 0, "_img_").otherwise("_txt_"), d % 10
    )
    kind = F.when(d % 50 == 7, "table").when(d % 3 == 0, "image").otherwise("text")
    return docs.select(
        "doc_id", key.alias("id"), page.alias("page"), kind.alias("type"),
        F.when(kind == "image", F.concat(F.lit("images/"), key, F.lit(".png"))).alias("content_path"),
        F.when(kind != "image", F.col("text")).alias("original_text"),
        F.when(d % 17 == 0, "N/A").when(d % 19 == 0, "").otherwise(text).alias("description_llm"),
        F.when(d % 23 != 0, _keywords(text)).alias("keywords_llm"),
    )


def clean(spark, sf):
    return corpus.clean(annotations(spark, sf))


def answers(spark, sf):
    d, k, turn = F.col("description_llm"), F.col("keywords_llm"), F.col("page") % 5
    summary, described, words = F.lit("RESUMO: "), F.lit("DESCRIÇÃO: "), F.lit(" PALAVRAS-CHAVE: ")
    return clean(spark, sf).select(
        "id",
        F.when(turn == 0, F.concat(summary, d, words, k))
        .when(turn == 1, F.concat(described, d, words, k))
        .when(turn == 2, F.concat(summary, d))
        .when(turn == 3, d)
        .otherwise(F.concat(F.lit("PALAVRAS-CHAVE: "), k, F.lit(" RESUMO: "), d, words, F.lit("x")))
        .alias("answer"),
    )


def pixels(spark, sf):
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        v.alias("image_id"), (v % 80 + 64).alias("width"), (v % 30 + 90).alias("height"),
        F.explode("embedding").alias("e"),
    ).select(
        "image_id", "width", "height",
        (F.lit(128.0) + (F.col("image_id") % 5 * 50 + 100) * F.col("e").cast("double")).alias("grey"),
    )


def images(spark, sf):
    """Decoded images in the form of the image source: the vector's coordinates as bytes,
    repeated over width x height pixels of three channels."""
    v = F.col("vec_id")
    level = lambda e: F.least(F.greatest(
        F.floor(F.lit(128.0) + (v % 5 * 50 + 100) * e.cast("double")), F.lit(0)), F.lit(255))
    two = lambda x: F.lpad(F.hex(x), 2, "0")
    pixel = lambda e: F.concat(two(F.lit(255) - level(e)), two(level(e)), two(level(e)))
    width, height = (v % 80 + 64).cast("int"), (v % 30 + 90).cast("int")
    tile = F.array_join(F.transform("embedding", pixel), "")
    repeats = F.ceil(width * height / F.size("embedding")).cast("int")
    data = F.unhex(F.substr(F.repeat(tile, repeats), F.lit(1), width * height * 6))
    return table(spark, sf, "embeddings").select(
        v.alias("image_id"),
        F.struct(
            F.concat(F.lit("images/"), v).alias("origin"), height.alias("height"),
            width.alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"),
            data.alias("data"),
        ).alias("image"),
    )


def image_bytes(spark, sf):
    """Stored image files: the bytes of a document; every fourth file is missing."""
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("images/"), d, F.lit(".png")).alias("content_path"),
        F.when(d % 4 != 0, F.encode("text", "UTF-8")).alias("content"),
    )


def vector_annotations(spark, sf, texts=False):
    """Clean annotations that bring the vectors their encoders would return.

    ``vis`` is the item's own vector, ``txt`` the next item's, ``txt2`` the one after.
    """
    emb = table(spark, sf, "embeddings")
    n = emb.count()
    v = F.col("vec_id")

    def shifted(by, name):
        return emb.select(F.pmod(v - by + n, n).alias("vec_id"), F.col("embedding").alias(name))

    kind = F.when(v % 3 == 0, "image").otherwise("text")
    base = (
        emb.join(shifted(1, "txt"), "vec_id").join(shifted(2, "txt2"), "vec_id")
        .select(
            v.alias("id"), "label", kind.alias("type"),
            (F.floor(v / 10) + 1).cast("int").alias("page"),
            F.col("embedding").alias("content"), "txt", "txt2",
            F.when(kind == "image", F.concat(F.lit("images/"), v, F.lit(".png"))).alias("content_path"),
        )
    )
    if not texts:
        return base.withColumn("description_llm", F.lit("d")).withColumn("keywords_llm", F.lit("k"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return base.join(docs, "id", "left").select(
        *base.columns, F.when(F.col("type") == "text", F.col("text")).alias("original_text"),
        F.coalesce("text", F.lit("d")).alias("description_llm"),
        F.coalesce(_keywords(F.col("text")), F.lit("k")).alias("keywords_llm"),
    )


def encoders():
    """Encoders that look their vector up: a text in the unified template reads ``txt2``,
    as another text gives another vector."""
    unified = V.TEMPLATE_UNIFIED.split("{")[0]

    def of_text(col):
        return F.when(F.contains(col, F.lit(unified)), F.col("txt2")).otherwise(F.col("txt"))

    both = approaches.Encoder(text=of_text, image=lambda c: c, width=64)
    text_only = approaches.Encoder(text=of_text, passage_prefix=V.PASSAGE_PREFIX,
                                   query_prefix=V.QUERY_PREFIX, width=64)
    return {V.TEXT_MODEL: text_only, V.JOINT_MODEL: both}


def word_encoders(width=64):
    """Models without weights: hashed words of a text, or of an image file's bytes."""
    words = E.hashed_words(width)
    texts = E.encoder(words, width)

    def file_words():
        predict = words()
        return lambda files: predict([None if f is None else bytes(f).decode("utf-8") for f in files])

    return {
        V.TEXT_MODEL: approaches.Encoder(text=texts, passage_prefix=V.PASSAGE_PREFIX,
                                         query_prefix=V.QUERY_PREFIX, width=width),
        V.JOINT_MODEL: approaches.Encoder(text=texts, image=E.encoder(file_words, width), width=width),
    }


def built_annotations(spark, sf, rows=None, cache=None):
    """The clean annotations under every approach, encoded from their texts and files."""
    files = image_bytes(spark, sf).withColumn(
        "content_path", F.regexp_replace("content_path", r"/(\d+)\.png$", r"/$1"))
    paths = (clean(spark, sf) if rows is None else rows).withColumn(
        "content_path", F.when(F.col("type") == "image", F.concat(F.lit("images/"), "doc_id")))
    return approaches.build(
        approaches.with_image_bytes(paths, files), word_encoders(), element_type="double", cache=cache)


def earlier_annotations(spark, sf):
    """The annotations as they were before every fifth got its present description."""
    old = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("earlier "), "description_llm")).otherwise(F.col("description_llm"))
    return clean(spark, sf).withColumn("description_llm", old)


def rebuilt(spark, sf):
    """(cache, items): a build over the earlier annotations, then one over the present ones with the same cache."""
    path = scratch_path(spark, "vector-cache")
    built_annotations(spark, sf, earlier_annotations(spark, sf), vector_cache.Cache(spark, path, "first"))
    cache = vector_cache.Cache(spark, path, "second")
    return cache, built_annotations(spark, sf, cache=cache)


def items(spark, sf, texts=False):
    return approaches.build(
        vector_annotations(spark, sf, texts), encoders(), element_type="double"
    )


def query_vectors(spark, sf):
    """Every vector is a query: under each approach, for texts and for images."""
    emb = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("txt")
    )
    model = approaches.Encoder(text=lambda c: F.col("txt"), query_prefix="", width=64)
    return approaches.query_vectors(
        emb.withColumn("query", F.concat(F.lit("q"), "query_id")),
        {V.TEXT_MODEL: model, V.JOINT_MODEL: model},
    )


def registry(spark):
    return approaches.registry_table(spark).select("approach_id").unionByName(
        spark.createDataFrame([(UNBUILT,)], "approach_id string")
    )


def _event_key():
    return F.get_json_object("props", "$.k")


def _approach():
    e, u = F.col("event_id"), F.col("user_id")
    pick = F.element_at(F.array(*[F.lit(a) for a in IDS]), (e % 4 + 1).cast("int"))
    return F.when((e % 4 == 3) & (u % 10 == 8), OTHER).otherwise(pick)


def evaluations(spark, sf):
    """The events table as votes. q9 has no relevant result; approach 4 has none for q8."""
    u = F.col("user_id")
    return table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.when(u % 7 == 0, "").when(u % 11 == 0, " ").otherwise(u.cast("string")).alias("evaluator"),
        _approach().alias("approach_id"),
        F.concat(F.lit("q"), u % 10).alias("query"),
        _event_key().alias("result_id"),
        F.when(F.col("event_type") == "error", "image").otherwise("text").alias("result_type"),
        (_event_key().cast("int") % 12 + 1).alias("result_page"),
        F.col("value").alias("result_score"),
        F.when((F.col("value") >= 60) & (u % 10 != 9), V.VOTE_RELEVANT)
        .otherwise(V.VOTE_NOT_RELEVANT).alias("evaluation"),
    )


def asked(spark, sf):
    """Votes next to the query text that was typed; some of either are empty."""
    u = F.col("user_id")
    return table(spark, sf, "events").select(
        "event_id",
        F.when(u % 7 == 0, "").when(u % 11 == 0, " ").otherwise(u.cast("string")).alias("evaluator"),
        F.when(u % 13 == 0, "").when(u % 5 == 0, " ").otherwise(F.concat(F.lit("q"), u % 10)).alias("query"),
    )


def clicks(spark, sf):
    """Thumbs on search results: the key of an event names the query, results are near it."""
    u, k = F.col("user_id"), _event_key().cast("bigint")
    return table(spark, sf, "events").select(
        "event_id",
        F.when(u % 7 == 0, "").otherwise(u.cast("string")).alias("evaluator"),
        _approach().alias("approach_id"), k.alias("query_id"),
        (k + F.col("event_id") % 3 - 1).alias("result_id"), (F.col("value") >= 60).alias("liked"),
    )


def users(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("username")
    )


def rating_records(spark, sf):
    d = F.col("doc_id")
    user = lambda shift: ((d + shift) % 150).cast("string").alias("user_id")
    responses = F.array(
        F.struct(user(0), F.col("quality").cast("int").alias("value")),
        F.struct(user(1), (F.lit(1) - F.col("toxic")).cast("int").alias("value")),
    )
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(
        F.concat(F.lit("q"), d % 10).alias("query"),
        F.col("text").alias("result_text"),
        F.format_string(V.PAGE_LABEL, d + 1).alias("page"),
        F.format_string(V.SCORE_LABEL, F.col("n_chars") / 65536).alias("score"),
        F.when(F.col("quality").isNotNull(), responses)
        .otherwise(F.array().cast(responses_type())).alias("responses"),
    )


def responses_type():
    return "array<struct<user_id:string,value:int>>"


def raw_ratings(spark, sf):
    """Ratings of which some are outside 0 and 1, or missing."""
    d = F.col("doc_id")
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", (F.col("quality") + F.when(d % 5 == 0, 2).otherwise(0)).cast("int").alias("value")
    )
