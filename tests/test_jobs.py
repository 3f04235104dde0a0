import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope import fixed_values as V, schemas
from folioscope.functions import encoders
from folioscope.plans import annotate, approaches, search as search_plan
from folioscope.sources import annotations as store, vectors
from folioscope.streaming import annotations as annotation_stream, evaluations as vote_stream
from folioscope.sources import evaluations
from tests.conftest import plan

BODY = "a block of text that is certainly long enough to be annotated, number "


def answering(broken=""):
    """Answers with the number at the end of the block; fails for the numbers given."""
    def make():
        def annotate_one(prompt):
            number = prompt.split("number ")[1].split()[0]
            if number in broken:
                raise RuntimeError("quota")
            return f"RESUMO: about {number} PALAVRAS-CHAVE: k{number}"

        return annotate_one

    return make


def some_pages(spark, numbers=range(6)):
    return spark.createDataFrame([(i // 2 + 1, f"short\n{BODY}{2 * (i // 2)}\n{BODY}{2 * (i // 2) + 1}") for i in numbers if i % 2 == 0],
                                 "page int, text string")


def test_annotate_resumes_and_retries(spark, tmp_path):
    path, pages = str(tmp_path / "store"), some_pages(spark)
    assert annotate.run(pages, path, answering(broken="3")) == (5, 1)
    assert annotate.run(pages, path, answering()) == (1, 0)
    assert annotate.run(pages, path, answering()) == (0, 0)
    rows = {r.id: (r.page, r.description_llm, r.keywords_llm, r.type, r.content_path) for r in store.read(spark, path).collect()}
    assert len(rows) == 6 and rows["p2_txt_2"] == (2, "about 3", "k3", "text", None)


def test_each_prompt_is_asked_once(spark):
    rows = some_pages(spark).withColumnRenamed("text", "prompt")
    answered = annotate.answer(rows, answering()).filter("error is null").withColumn("n", F.length("answer"))
    text = plan(annotate.corpus.parse_answers(answered))
    assert text.count("ArrowEvalPython") == 1


def two_documents(spark):
    """Pages that share their numbers, and so the ids of their blocks."""
    return spark.createDataFrame([("a", 1, f"{BODY}0\n{BODY}1"), ("b", 1, f"{BODY}2\n{BODY}3")], "doc_id string, page int, text string")


def test_resume_by_document(spark, tmp_path):
    path, pages = str(tmp_path / "store"), two_documents(spark)
    assert annotate.run(pages.filter("doc_id = 'a'"), path, answering()) == (2, 0)
    assert annotate.run(pages.filter("doc_id = 'b'"), path, answering(broken="3")) == (1, 1)
    assert annotate.run(pages, path, answering()) == (1, 0)
    assert annotate.run(pages, path, answering()) == (0, 0)
    rows = {(r.doc_id, r.id): r.description_llm for r in store.read(spark, path).collect()}
    assert rows == {("a", "p1_txt_0"): "about 0", ("a", "p1_txt_1"): "about 1", ("b", "p1_txt_0"): "about 2", ("b", "p1_txt_1"): "about 3"}


def test_rows_decide_the_number_of_tasks(spark):
    todo = spark.range(10).select(F.col("id").cast("string").alias("id"))
    assert annotate.spread_rows(todo, 3).rdd.getNumPartitions() == 4
    assert annotate.spread_rows(todo.limit(0), 3).rdd.getNumPartitions() == 1


def image_table(spark, *rows):
    """(doc_id, id, width, height, value per pixel): grey ramps are kept, flat and small ones go."""
    return spark.createDataFrame(
        [(d, i, 1, f"images/{i}.png", ("x", h, w, 1, 0, bytearray((j * step) % 256 for j in range(w * h)))) for d, i, w, h, step in rows],
        "doc_id string, id string, page int, content_path string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")


def test_images_are_annotated_from_prompt_and_bytes(spark, tmp_path):
    path = str(tmp_path / "store")
    images = image_table(spark, ("a", "p1_img_0", 110, 100, 1), ("a", "p1_img_1", 110, 100, 0), ("b", "p1_img_0", 120, 100, 3), ("b", "p1_img_2", 20, 20, 1))

    def seeing(broken=0):
        def annotate_one(prompt, image):
            if len(image) == broken:
                raise RuntimeError("quota")
            return f"DESCRIÇÃO: {'prompt' if prompt == V.IMAGE_PROMPT else '?'} {len(image)} PALAVRAS-CHAVE: k"

        return lambda: annotate_one

    assert annotate.run_images(images, path, seeing(broken=12_000)) == (1, 1)
    assert annotate.run_images(images, path, seeing()) == (1, 0)
    assert annotate.run_images(images, path, seeing()) == (0, 0)
    rows = {(r.doc_id, r.id): (r.type, r.content_path, r.description_llm, r.original_text) for r in store.read(spark, path).collect()}
    assert rows == {("a", "p1_img_0"): ("image", "images/p1_img_0.png", "prompt 11000", None), ("b", "p1_img_0"): ("image", "images/p1_img_0.png", "prompt 12000", None)}

    folder, mark, streamed = (str(tmp_path / n) for n in ("in", "mark", "streamed"))
    images.write.parquet(folder)
    read = spark.readStream.schema(images.schema).parquet(folder)
    annotation_stream.run_images(read, streamed, mark, seeing()).awaitTermination()
    as_set = lambda p: sorted(map(str, store.read(spark, p).collect()))
    assert as_set(streamed) == as_set(path)


def test_images_that_fail_are_asked_again(spark, tmp_path):
    folder, path, mark = (str(tmp_path / n) for n in ("in", "store", "mark"))
    images = image_table(spark, ("a", "p1_img_0", 110, 100, 1), ("b", "p1_img_0", 120, 100, 3), ("b", "p1_img_1", 110, 100, 0))

    def failing(size):
        def annotate_one(prompt, image):
            if len(image) == size:
                raise RuntimeError("quota")
            return f"DESCRIÇÃO: {len(image)} PALAVRAS-CHAVE: k"

        return lambda: annotate_one

    images.write.parquet(folder)
    read = lambda: spark.readStream.schema(images.schema).parquet(folder)
    annotation_stream.run_images(read(), path, mark, failing(12_000)).awaitTermination()
    assert [r.doc_id for r in annotation_stream.failed(spark, path, "image").collect()] == ["b"]
    annotation_stream.run_images(read(), path, mark, failing(0)).awaitTermination()  # no file has come again
    assert sorted(r.description_llm for r in store.read(spark, path).collect()) == ["11000", "12000"]
    assert annotation_stream.failed(spark, path, "image").isEmpty()


def test_an_answer_that_is_no_text_is_an_error(spark):
    df = spark.createDataFrame([("p",)], "prompt string")
    row = annotate.answer(df, lambda: (lambda prompt: None)).first()
    assert row.answer is None and row.error.startswith("TypeError")


def test_image_annotations(spark):
    df = spark.createDataFrame([("p1_img_0", 1, "images/x.png", "DESCRIÇÃO: d PALAVRAS-CHAVE: k", None), ("p1_img_1", 1, "y", None, "E: x")],
                               "id string, page int, content_path string, answer string, error string")
    rows = annotate.image_annotations(df).collect()
    assert [(r.id, r.type, r.description_llm, r.original_text) for r in rows] == [("p1_img_0", "image", "d", None)]


def test_streamed_annotate_equals_batch(spark, tmp_path):
    folder, path, mark = (str(tmp_path / n) for n in ("in", "store", "mark"))
    pages = some_pages(spark)
    read = lambda: spark.readStream.schema(pages.schema).parquet(folder)
    pages.filter("page < 3").write.mode("append").parquet(folder)
    annotation_stream.run(read(), path, mark, answering()).awaitTermination()
    assert store.read(spark, path).count() == 4
    pages.filter("page >= 2").write.mode("append").parquet(folder)  # page 2 comes again
    annotation_stream.run(read(), path, mark, answering()).awaitTermination()
    batch = str(tmp_path / "batch")
    annotate.run(pages, batch, answering())
    as_set = lambda p: sorted(tuple(r) for r in store.read(spark, p).drop("content_path").collect())
    assert as_set(path) == as_set(batch)


def test_streamed_annotate_keeps_documents_apart_and_asks_again(spark, tmp_path):
    folder, path, mark = (str(tmp_path / n) for n in ("in", "store", "mark"))
    pages = two_documents(spark)
    read = lambda: spark.readStream.schema(pages.schema).parquet(folder)
    pages.write.mode("append").parquet(folder)
    annotation_stream.run(read(), path, mark, answering(broken="013")).awaitTermination()
    assert [(r.doc_id, r.id) for r in store.read(spark, path).collect()] == [("b", "p1_txt_0")]
    annotation_stream.run(read(), path, mark, answering(broken="0")).awaitTermination()  # nothing new has come
    assert store.read(spark, path).count() == 3
    spark.createDataFrame([("c", 1, f"{BODY}9")], pages.schema).write.mode("append").parquet(folder)
    annotation_stream.run(read(), path, mark, answering()).awaitTermination()
    assert annotation_stream.failed(spark, path).isEmpty()
    batch = str(tmp_path / "batch")
    annotate.run(spark.read.parquet(folder), batch, answering())
    as_set = lambda p: sorted(map(str, store.read(spark, p).collect()))
    assert as_set(path) == as_set(batch) and len(as_set(path)) == 5


EVAL = ["2024-01-01T00:00:00", "ana", "a1", "q", "r", "text", 1, 0.5, "relevante"]


def votes_frame(spark, *changes):
    rows = [tuple({**dict(zip(schemas.EVALUATION.fieldNames(), EVAL)), **c}.values()) for c in changes]
    return spark.createDataFrame(rows, schemas.EVALUATION)


def test_vote_stream_is_exactly_once(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    evaluations.append(votes_frame(spark, {}, {"evaluator": ""}), folder)
    (tmp_path / "in" / "broken.json").write_text('{"evaluator": \n\n')
    vote_stream.ingest(spark, folder, out, mark).awaitTermination()
    vote_stream.ingest(spark, folder, out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 1
    evaluations.append(votes_frame(spark, {"result_id": "r2"}), folder)
    vote_stream.ingest(spark, folder, out, mark).awaitTermination()
    assert sorted(r.result_id for r in spark.read.parquet(out).collect()) == ["r", "r2"]


def test_running_precision_equals_batch(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    first = votes_frame(spark, {}, {"evaluation": "nao_relevante"}, {"approach_id": "a2"})
    second = votes_frame(spark, {"evaluation": "nao_relevante"}, {"approach_id": "a3", "evaluation": "?"})
    for part in (first, second):
        evaluations.append(part, folder)
        vote_stream.write_running_precision(evaluations.read_stream(spark, folder), out, mark).awaitTermination()
    got = {r.approach_id: (r.votes, r.precision) for r in spark.read.parquet(out).collect()}
    want = {r.approach_id: (r.votes, r.precision) for r in vote_stream.running_precision(first.unionByName(second)).collect()}
    assert got == want and got["a1"] == (3, pytest.approx(1 / 3))


WIDTH = 3


def text_model(offset):
    """Vector: (length of the text, offset, 1)."""
    def make():
        return lambda batch: np.array([[len(t), offset, 1.0] for t in batch])

    return encoders.encoder(make, WIDTH)


def image_model():
    def predict(batch):
        if any(b is None or bytes(b) == b"bad" for b in batch):
            raise ValueError("cannot decode")
        return np.array([[float(len(b)), 0.0, 0.0] for b in batch])

    return predict


def models():
    return {
        V.TEXT_MODEL: approaches.Encoder(text=text_model(7), passage_prefix="passage: ", query_prefix="query: ", width=WIDTH),
        V.JOINT_MODEL: approaches.Encoder(text=text_model(2), image=encoders.encoder(image_model, WIDTH), width=WIDTH),
    }


def unit(*v):
    v = np.array(v, dtype=float)
    return v / np.linalg.norm(v)


def clean_rows(spark):
    return spark.createDataFrame(
        [("t", 1, "text", None, "o", "d", "k", None), ("i", 1, "image", "p", None, "d", "k", bytearray(b"12345")),
         ("b", 2, "image", "q", None, "d", "k", bytearray(b"bad")), ("m", 2, "image", "r", None, "d", "k", None), ("x", 2, "table", None, "o", "d", "k", None)],
        "id string, page int, type string, content_path string, original_text string, description_llm string, keywords_llm string, content binary")


def test_build_of_the_four_approaches(spark):
    rows = approaches.build(clean_rows(spark), models(), element_type="double").collect()
    got = {(r.approach_id, r.id): r for r in rows}
    assert len(rows) == 4 * 4 and not any(r.id == "x" for r in rows)
    text, image, unified = "Conteúdo sobre: d. Termos relacionados: k", "Imagem mostrando: d. Termos relacionados: k", "Descrição: d. Palavras-chave: k"
    a1, a2, a3, a4 = [a.approach_id for a in approaches.REGISTRY]
    n = len("passage: ")

    def check(a, i, vector):
        assert np.allclose(got[a, i].vector, vector, atol=1e-6), (a, i, got[a, i].vector, vector)

    check(a1, "t", unit(len(text) + n, 7, 1))
    check(a1, "i", unit(len(image) + n, 7, 1))
    check(a1, "b", unit(len(image) + n, 7, 1))
    check(a2, "t", unit(len(text) + n, 7, 1))
    check(a2, "i", unit(*(0.4 * unit(5, 0, 0) + 0.6 * unit(len(image), 2, 1))))
    check(a3, "t", unit(len(text), 2, 1))
    check(a3, "i", unit(5, 0, 0))
    check(a4, "t", unit(len(unified), 2, 1))
    check(a4, "i", unit(*(0.4 * unit(5, 0, 0) + 0.6 * unit(len(unified), 2, 1))))
    for a in (a2, a3, a4):
        for failed in ("b", "m"):
            check(a, failed, np.zeros(3))
    assert got[a4, "t"].text_for_embedding == unified and got[a1, "i"].text_for_embedding == image


def test_an_input_is_encoded_once_for_all_approaches(spark):
    text = plan(approaches.build(clean_rows(spark), models()))
    calls = [line for line in text.splitlines() if "ArrowEvalPython" in line]
    # texts: passage, plain, unified; images: passage, pixels, plain, unified
    assert sum(line.split("], [")[0].count("predict") for line in calls) == 7


def test_image_bytes_are_attached_by_path(spark):
    files = spark.createDataFrame([("p", bytearray(b"1")), ("z", bytearray(b"2"))], "content_path string, content binary")
    rows = {r.id: r.content for r in approaches.with_image_bytes(clean_rows(spark).drop("content"), files).collect()}
    assert rows == {"t": None, "i": bytearray(b"1"), "b": None, "m": None, "x": None}


def test_search_from_the_store(spark, tmp_path):
    path = str(tmp_path / "vectors")
    vectors.write(approaches.build(clean_rows(spark), models()), path)
    asked = spark.createDataFrame([(1, "o que é?"), (2, "")], "query_id int, query string")
    hits = search_plan.answer(asked, vectors.read(spark, path), models())
    rows = hits.collect()
    assert {r.query_id for r in rows} == {1}
    assert {(r.approach_id, r.type) for r in rows} == {(a.approach_id, t) for a in approaches.REGISTRY for t in ("text", "image")}
    failed = [r for r in rows if r.id == "b" and r.approach_id == V.APPROACH_JOINT]
    assert [r.score for r in failed] == [0.0] and len([r for r in rows if r.type == "image"]) == 12
