"""The registered queries: each runs one operator over whole driver tables."""

from pyspark.sql import functions as F

from folioscope import fixed_values as V, schemas
from folioscope.functions import encoders, text as X, vectors as U
from folioscope.operators import clusters, corpus, embedtext, images, profile, ratings, search, votes
from folioscope.plans import annotate, approaches, judge, search as search_plan
from folioscope.session import scratch_path, stored
from folioscope.sources import annotations, evaluations, records, vectors, versions
from folioscope.streaming import annotations as annotation_stream, evaluations as vote_stream, quality as quality_stream

from . import views

QUERIES = {}
HASH_WIDTH = 256
BY = ("approach_id", "type")


def query(f):
    QUERIES[f.__name__] = f
    return f


def _coordinates(df, vector, *keys):
    """One row per coordinate, so vectors compare as plain numbers."""
    return df.select(*keys, F.posexplode_outer(vector).alias("i", "x")).select(
        *keys, "i", F.round("x", 6).alias("x")
    )


def _rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


# --- corpus ---------------------------------------------------------------------


@query
def block_explode(spark, sf):
    return views.blocks(spark, sf).select("doc_id", "id", "page", "block_index", "text")


@query
def text_relevance(spark, sf):
    return corpus.keep_texts(views.blocks(spark, sf), phrases=views.STOP_PHRASES).select("doc_id", "id", "text")


@query
def text_length_only(spark, sf):
    return corpus.keep_texts(views.blocks(spark, sf), "length_only").select("doc_id", "id", "text")


@query
def annotation_resume(spark, sf):
    return corpus.not_done(views.blocks(spark, sf), views.done(spark, sf)).select("doc_id", "id", "text")


@query
def prompt_table(spark, sf):
    kept = corpus.keep_texts(views.blocks(spark, sf), phrases=views.STOP_PHRASES)
    texts = corpus.prompts(kept).select("doc_id", "id", "prompt")
    pictures = corpus.image_prompts(images.keep_images(views.images(spark, sf)))
    return texts.unionByName(pictures.select(
        F.lit("images").alias("doc_id"), F.col("image_id").cast("string").alias("id"), "prompt"))


@query
def llm_response_parse(spark, sf):
    return corpus.parse_answers(views.answers(spark, sf)).select("id", "description_llm", "keywords_llm")


@query
def annotation_clean(spark, sf):
    return views.clean(spark, sf).select("id", "page", "type", "description_llm", "keywords_llm")


@query
def split_by_type(spark, sf):
    return corpus.of_type(views.clean(spark, sf), "text", "image").select("id", "type")


@query
def embedding_text_by_type(spark, sf):
    return embedtext.with_embedding_text(views.clean(spark, sf)).select("id", "text_for_embedding")


@query
def embedding_text_unified(spark, sf):
    return embedtext.with_embedding_text(views.clean(spark, sf), V.TEMPLATE_UNIFIED) \
        .select("id", "text_for_embedding")


@query
def encoder_prefix(spark, sf):
    return embedtext.with_embedding_text(views.clean(spark, sf)).select(
        "id", embedtext.prefixed("text_for_embedding").alias("passage"),
        embedtext.prefixed("description_llm", V.QUERY_PREFIX).alias("question"),
    )


@query
def snippet_label(spark, sf):
    return views.documents(spark, sf).select(
        "doc_id", X.first_words(F.col("text")).alias("snippet"), X.short_label("text").alias("label")
    )


@query
def annotate_batch(spark, sf):
    kept = corpus.keep_texts(views.blocks(spark, sf), phrases=views.STOP_PHRASES)
    answered = annotate.answer(corpus.prompts(kept), counting_annotator)
    return corpus.parse_answers(answered).select("doc_id", "id", "description_llm", "keywords_llm", "error")


@query
def annotate_images(spark, sf):
    """Image rows through filter, prompt with bytes, annotator and store."""
    path = scratch_path(spark, "image-annotations")
    rows = views.images(spark, sf).select(
        F.concat(F.lit("d"), F.col("image_id") % 2).alias("doc_id"),
        corpus.item_id(F.floor(F.col("image_id") / 2) + 1, "img", F.lit(0)).alias("id"),
        (F.floor(F.col("image_id") / 2) + 1).cast("int").alias("page"),
        F.concat(F.lit("images/"), "image_id", F.lit(".png")).alias("content_path"), "image")
    annotate.run_images(rows, path, counting_image_annotator)
    return annotations.read(spark, path).select("doc_id", "id", "page", "type", "content_path", "description_llm", "keywords_llm")


def counting_image_annotator():
    """The stand-in for images: it sees the prompt and the bytes."""
    counting = counting_annotator()
    return lambda prompt, image: counting(prompt + "x" * len(image))


def counting_annotator():
    """A deterministic stand-in for a model; it fails on every seventh length."""
    def annotate_one(prompt):
        n = len(prompt)
        if n % 7 == 0:
            raise ValueError("busy")
        return f"RESUMO: {n} chars PALAVRAS-CHAVE: a{n % 3}, b{n % 5}"

    return annotate_one


@query
def image_filter_pixels(spark, sf):
    return _rounded(images.keep_pixel_tables(views.pixels(spark, sf)), "grey_std")


@query
def image_filter_bytes(spark, sf):
    kept = images.keep_images(views.images(spark, sf))
    return kept.select("image_id", "image.width", "image.height", F.round("grey_std", 6).alias("grey_std"))


# --- vectors and search -----------------------------------------------------------


@query
def vector_normalize(spark, sf):
    scaled = views.table(spark, sf, "embeddings").withColumn(
        "v", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 4)))
    return _coordinates(scaled.withColumn("v", U.l2_normalize("v")), "v", "vec_id")


@query
def vector_fuse(spark, sf):
    pairs = views.vector_annotations(spark, sf)
    return _coordinates(pairs.withColumn("v", U.fuse("content", "txt")), "v", "id")


@query
def vector_zero_fallback(spark, sf):
    broken = views.table(spark, sf, "embeddings").withColumn(
        "v", F.when(F.col("vec_id") % 7 != 0, F.col("embedding")))
    filled = broken.withColumn("v", U.zero_if_missing("v", 64)).withColumn("v", U.l2_normalize("v"))
    return filled.select("vec_id", F.round(U.norm("v"), 6).alias("length"), F.size("v").alias("width"))


def _own_vectors(spark, sf):
    emb = views.table(spark, sf, "embeddings")
    items = emb.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    asked = emb.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return items, asked


@query
def topk_search(spark, sf):
    items, asked = _own_vectors(spark, sf)
    return search.top_k(items, asked, keep=("label",))


@query
def topk_search_grid(spark, sf):
    """The same answers when the queries are too many to send at once."""
    items, asked = _own_vectors(spark, sf)
    return search.top_k(items, asked, keep=("label",), max_sent_queries=1000)


@query
def topk_search_clustered(spark, sf):
    """The same answers from a store with clusters, of which a query reads those that can matter."""
    items, asked = _own_vectors(spark, sf)
    path = scratch_path(spark, "clustered")
    rows = clusters.clustered(stored(items, "items"))
    versions.replace(rows, path, partition_by=("cluster",))
    return clusters.top_k(versions.read(spark, path, rows.schema), asked, keep=("label",))


@query
def dual_search(spark, sf):
    return search.top_k(views.items(spark, sf), views.query_vectors(spark, sf), by=BY, keep=("page",))


@query
def approach_compare(spark, sf):
    """How much two approaches agree: results per query that each found, with best score."""
    return search.agreement(dual_search(spark, sf))


@query
def best_page(spark, sf):
    items = views.items(spark, sf, texts=True)
    hits = search.top_k(items, views.query_vectors(spark, sf), k=1, by=BY, keep=("page",))
    return search.best_page(hits, items=items)


@query
def approach_build(spark, sf):
    return _coordinates(views.items(spark, sf), "vector", "approach_id", "type", "id", "page")


@query
def encode_batch(spark, sf):
    encode = encoders.encoder(encoders.hashed_words(64), 64)
    docs = views.documents(spark, sf)
    return _coordinates(
        docs.withColumn("v", encode("text")).withColumn("v", U.l2_normalize("v")), "v", "doc_id")


@query
def hashed_text_search(spark, sf):
    encode = encoders.encoder(encoders.hashed_words(HASH_WIDTH), HASH_WIDTH)
    docs = views.documents(spark, sf).select(
        F.col("doc_id").alias("id"), encode("text").alias("vector"))
    asked = views.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), encode("text").alias("vector"))
    return search.top_k(docs, asked)


@query
def search_job(spark, sf):
    """Annotations to vectors to answers: benchmark texts ask under every approach."""
    asked = views.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search_plan.answer(asked, views.built_annotations(spark, sf), views.word_encoders(), fetch=()) \
        .drop("doc_id")


@query
def rebuild_vectors(spark, sf):
    """A build that finds most of its vectors in the cache of an earlier one."""
    return _coordinates(views.rebuilt(spark, sf)[1], "vector", "approach_id", "type", "id", "page")


@query
def rebuild_encodes(spark, sf):
    """The encoder calls of both builds: every distinct input once, in the second only what is new."""
    return views.rebuilt(spark, sf)[0].encodes()


@query
def approach_lookup(spark, sf):
    """Votes with the configuration of the approach they were cast under."""
    used = views.evaluations(spark, sf).groupBy("approach_id").agg(F.count(F.lit(1)).alias("votes"))
    return approaches.with_configuration(used).select(
        "approach_id", "votes", "text_model", "image_model", "image_from", "template")


# --- votes and ratings ----------------------------------------------------------------


@query
def retrieval_flagship(spark, sf):
    """Search and judge end to end: every vector asks for its neighbours under each
    approach, a result is relevant when it has the query's label."""
    hits = search.top_k(views.items(spark, sf), views.query_vectors(spark, sf), by=BY, keep=("label",))
    own = views.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    judged = hits.join(own, "query_id")
    as_votes = votes.hits_as_evaluations(judged, F.col("label") == F.col("query_label"))
    return _rounded(judge.quality(as_votes, views.registry(spark)), "precision", "recall", "f1")


@query
def truth_sets(spark, sf):
    return votes.truth_sets(views.evaluations(spark, sf))


@query
def truth_size(spark, sf):
    return votes.truth_size(views.evaluations(spark, sf))


@query
def relevance_labels(spark, sf):
    return votes.labelled(views.evaluations(spark, sf)).groupBy("approach_id", "evaluation").agg(
        F.sum("is_relevant").alias("relevant"), F.count(F.lit(1)).alias("votes"))


@query
def retrieval_confusion(spark, sf):
    return votes.confusion(views.evaluations(spark, sf))


@query
def retrieval_prf(spark, sf):
    rows = votes.prf(votes.confusion(views.evaluations(spark, sf)))
    return _rounded(rows, "precision", "recall", "f1").select(
        "approach_id", "query", "precision", "recall", "f1")


@query
def retrieval_macro(spark, sf):
    rows = judge.quality(views.evaluations(spark, sf), views.registry(spark))
    return _rounded(rows, "precision", "recall", "f1")


@query
def metrics_report(spark, sf):
    rows = judge.report(views.evaluations(spark, sf), views.registry(spark))
    return _rounded(rows, "precision", "recall", "f1")


@query
def false_positives(spark, sf):
    return votes.false_positives(views.evaluations(spark, sf))


@query
def false_negatives(spark, sf):
    return votes.false_negatives(views.evaluations(spark, sf))


@query
def retrieved_relevant(spark, sf):
    return votes.retrieved_relevant(views.evaluations(spark, sf), V.APPROACH_HYBRID)


@query
def evaluation_guards(spark, sf):
    return votes.storable(votes.askable(views.asked(spark, sf)))


@query
def evaluation_events(spark, sf):
    hits = stored(dual_search(spark, sf), "hits")
    rows = votes.events(hits, views.clicks(spark, sf), query="query_id")
    return rows.drop("timestamp")


@query
def rating_records(spark, sf):
    items = views.items(spark, sf, texts=True).filter(F.col("approach_id") == V.APPROACH_TEXT_ONLY)
    asked = views.query_vectors(spark, sf).filter(
        (F.col("approach_id") == V.APPROACH_TEXT_ONLY) & (F.col("type") == "text"))
    hits = search.top_k(items, asked, by=BY, keep=("page",), fetch=("text_for_embedding",))
    # the label is rounded by another rule in Java than in C, so its number is compared to three places
    label = F.regexp_extract("score", r"Score: (-?[0-9]+\.[0-9]{4})$", 1).cast("double")
    near = F.abs(label - F.col("exact")) <= 0.00005 + 1e-9
    rows = ratings.text_records(hits.withColumn("query_id", F.struct("query_id", "score")), query="query_id")
    return rows.select("query.query_id", "result_text", "page", F.col("query.score").alias("exact"), "score") \
        .select(F.col("query_id").alias("query"), "result_text", "page", "exact", near.alias("label_fits"))


@query
def rating_records_multimodal(spark, sf):
    items = views.items(spark, sf, texts=True).filter(F.col("approach_id") == V.APPROACH_UNIFIED)
    asked = views.query_vectors(spark, sf).filter(F.col("approach_id") == V.APPROACH_UNIFIED)
    hits = search.top_k(items, asked, by=BY, fetch=("text_for_embedding", "content_path"))
    return ratings.multimodal_records(
        stored(hits, "hits"), views.image_bytes(spark, sf), query="query_id")


@query
def ratings_flatten(spark, sf):
    return ratings.flatten(views.rating_records(spark, sf), views.users(spark, sf)).drop("score")


@query
def ratings_completed(spark, sf):
    rows = ratings.flatten(views.rating_records(spark, sf), views.users(spark, sf))
    return ratings.completed(rows).select("query", "page", "user", "value")


@query
def rating_overall(spark, sf):
    return _rounded(ratings.overall(views.rating_records(spark, sf)), "precision")


@query
def rating_by_user(spark, sf):
    return _rounded(ratings.by_user(views.rating_records(spark, sf), views.users(spark, sf)), "precision")


@query
def rating_domain(spark, sf):
    ok, rejected = ratings.split_domain(views.raw_ratings(spark, sf))
    return ok.withColumn("accepted", F.lit(True)).unionByName(rejected.withColumn("accepted", F.lit(False)))


# --- profile ----------------------------------------------------------------------------


def _with_text(spark, sf):
    return embedtext.with_embedding_text(views.clean(spark, sf))


@query
def page_count(spark, sf):
    return profile.page_count(views.clean(spark, sf))


@query
def items_per_page_stats(spark, sf):
    return _rounded(profile.items_per_page_stats(views.clean(spark, sf)), "mean", "std")


@query
def describe_lengths(spark, sf):
    lengths = profile.lengths(_with_text(spark, sf))
    return _rounded(profile.describe(lengths, ["desc_len", "kw_count", "embed_len"]), "mean", "std")


@query
def mean_len_by_type(spark, sf):
    return _rounded(profile.mean_length_by_type(views.clean(spark, sf)), "mean_desc_len")


@query
def count_by_type(spark, sf):
    return profile.count_by_type(views.clean(spark, sf))


@query
def column_overview(spark, sf):
    return profile.column_overview(views.annotations(spark, sf).drop("doc_id"))


@query
def first_rows(spark, sf):
    return profile.first_rows(views.clean(spark, sf), ["id"]).select("id", "page", "type", "keywords_llm")


@query
def table_counts(spark, sf):
    clean = views.clean(spark, sf)
    return profile.table_counts(annotations=views.annotations(spark, sf), clean=clean,
                                records=views.rating_records(spark, sf))


@query
def length_histogram(spark, sf):
    rows = profile.histogram(profile.lengths(_with_text(spark, sf)), "embed_len", V.LENGTH_BINS)
    return _rounded(rows, "lower", "upper")


@query
def page_histogram(spark, sf):
    return _rounded(profile.histogram(views.clean(spark, sf), "page", V.PAGE_BINS), "lower", "upper")


@query
def top_pages(spark, sf):
    return profile.top_pages(views.clean(spark, sf))


@query
def word_frequency(spark, sf):
    return _rounded(profile.word_frequency(views.clean(spark, sf)), "weight")


@query
def top_ngrams(spark, sf):
    return profile.top_ngrams(views.clean(spark, sf))


@query
def top_ngrams_two_three(spark, sf):
    return profile.top_ngrams(views.documents(spark, sf), text="text", sizes=(2, 3))


# --- stores and streams --------------------------------------------------------------------


@query
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "annotations-csv")
    annotations.write_csv(views.annotations(spark, sf), path)
    return annotations.read_csv(spark, path).drop("doc_id")


@query
def clean_table_roundtrip(spark, sf):
    path = scratch_path(spark, "clean")
    rows = _with_text(spark, sf)
    annotations.replace_clean(rows, path)
    return annotations.read_clean(spark, path, rows.schema).select("id", "page", "type", "text_for_embedding")


@query
def jsonl_roundtrip(spark, sf):
    path = scratch_path(spark, "evaluations")
    evaluations.append(votes.storable(views.evaluations(spark, sf)), path)
    return evaluations.read(spark, path)


@query
def nested_roundtrip(spark, sf):
    path = scratch_path(spark, "records")
    source = views.rating_records(spark, sf)
    records.create_if_absent(source, path)
    records.create_if_absent(source, path)
    stored = records.read(spark, path, schemas.RATING_RECORD)
    return stored.select("query", "page", F.size("responses").alias("responses"),
                         F.explode_outer("responses").alias("r")) \
        .select("query", "page", "responses", "r.user_id", "r.value")


def _vector_store(spark, sf):
    path = scratch_path(spark, "vectors")
    vectors.write(views.items(spark, sf).withColumn("id", F.col("id").cast("string")), path)
    return vectors.read(spark, path)


@query
def vector_store_roundtrip(spark, sf):
    """Every coordinate as it comes back from the store."""
    return _vector_store(spark, sf).select("approach_id", "type", "id", "page", F.posexplode("vector").alias("i", "x")) \
        .withColumn("x", F.round(F.col("x").cast("double"), 5) + F.lit(0.0))


@query
def vector_store_status(spark, sf):
    items = _vector_store(spark, sf)
    failed = vectors.failures(items).groupBy("approach_id").agg(F.sum("failed").alias("failed"))
    return vectors.build_status(items, views.registry(spark)).join(failed, "approach_id", "left")


@query
def evaluation_stream(spark, sf):
    folder, out, mark = (scratch_path(spark, n) for n in ("votes-in", "votes-out", "votes-mark"))
    evaluations.append(views.evaluations(spark, sf), folder)
    vote_stream.ingest(spark, folder, out, mark).awaitTermination()
    return spark.read.schema(schemas.EVALUATION).parquet(out)


@query
def stream_precision(spark, sf):
    folder, out, mark = (scratch_path(spark, n) for n in ("votes-in", "precision", "precision-mark"))
    evaluations.append(views.evaluations(spark, sf), folder)
    own = spark.newSession()  # its state has a handful of keys, so few state partitions do
    own.conf.set("spark.sql.shuffle.partitions", "4")
    vote_stream.write_running_precision(evaluations.read_stream(own, folder), out, mark).awaitTermination()
    return _rounded(vote_stream.read_running_precision(spark, out), "precision")


@query
def stream_quality(spark, sf):
    """Macro precision, recall and F1 kept up to date: in the first batch nothing is relevant yet, the second brings the
    votes that make results relevant and so corrects what was counted before."""
    folder, out, mark = (scratch_path(spark, n) for n in ("votes-in", "quality", "quality-mark"))
    rows, own = views.evaluations(spark, sf), quality_stream.session(spark, 4)
    for part in (rows.filter(F.col("evaluation") != V.VOTE_RELEVANT), rows.filter(F.col("evaluation") == V.VOTE_RELEVANT)):
        evaluations.append(part, folder)
        quality_stream.write(evaluations.read_stream(own, folder), out, mark).awaitTermination()
    return _rounded(quality_stream.read(spark, out, views.registry(spark)), "precision", "recall", "f1")


@query
def annotate_stream(spark, sf):
    out, mark = scratch_path(spark, "annotations"), scratch_path(spark, "annotate-mark")
    schema = views.table(spark, sf, "documents").schema
    pages = (  # a glob, as a stream takes a folder or a glob but no single file
        spark.readStream.schema(schema).parquet(f"{sf}/documents.parque[t]")
        .select(*views.page_of(F.col("doc_id")), "text")
    )
    # the first model fails on some prompts; a later run with a sound one asks only about those
    for model in (counting_annotator, length_annotator):
        annotation_stream.run(pages, out, mark, model, phrases=views.STOP_PHRASES).awaitTermination()
    return annotations.read(spark, out).select("doc_id", "id", "page", "type", "description_llm", "keywords_llm")


def length_annotator():
    return lambda prompt: f"RESUMO: second {len(prompt)} PALAVRAS-CHAVE: again"
