import json

import pandas as pd
from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.operators import corpus
from folioscope.plans import approaches
from folioscope.sources import annotations, evaluations, pages, records, vectors

CSV_ROWS = [
    {"id": "a", "page": 1, "type": "text", "content_path": "", "original_text": 'two\nlines, "quoted"', "description_llm": "d", "keywords_llm": "x, y"},
    {"id": "b", "page": 2, "type": "image", "content_path": "images/b.png", "original_text": "", "description_llm": "N/A", "keywords_llm": "N/A"},
    {"id": "ç", "page": 3, "type": "text", "content_path": "", "original_text": "  padded ", "description_llm": "é", "keywords_llm": "k"},
]


def test_csv_with_bom_and_quoting(spark, tmp_path):
    path = tmp_path / "annotations.csv"
    pd.DataFrame(CSV_ROWS).to_csv(path, index=False, encoding="utf-8-sig")
    rows = annotations.read_csv(spark, str(path)).orderBy("page").collect()
    assert [r.id for r in rows] == ["a", "b", "ç"]
    assert rows[0].original_text == 'two\nlines, "quoted"' and rows[0].content_path is None
    assert rows[2].original_text == "  padded " and rows[0].page == 1
    assert [r.id for r in corpus.clean(annotations.read_csv(spark, str(path))).collect()] == ["a", "ç"]


def test_pages_written_as_floats(spark, tmp_path):
    path = tmp_path / "a.csv"
    pd.DataFrame([{**CSV_ROWS[0], "page": 3.0}, {**CSV_ROWS[1], "page": None}]).to_csv(path, index=False)
    assert sorted([r.page for r in annotations.read_csv(spark, str(path)).collect()], key=str) == [3, None]


def test_csv_written_here_reads_back_and_appends(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([tuple(r.values()) for r in CSV_ROWS], schemas.ANNOTATION_FILE)
    annotations.write_csv(df, path)
    annotations.write_csv(df, path)
    back = annotations.read_csv(spark, path)
    assert back.count() == 6
    assert {r.original_text for r in back.collect()} == {'two\nlines, "quoted"', None, "  padded "}
    written = "".join(f.read_text(encoding="utf-8") for f in (tmp_path / "out").glob("part*.csv"))
    assert '"two\nlines, ""quoted""' in written


def test_annotation_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert annotations.read(spark, path).count() == 0
    df = spark.createDataFrame([tuple(r.values()) for r in CSV_ROWS], schemas.ANNOTATION_FILE)
    assert annotations.append_counted(df, path) == 3
    annotations.append(df.limit(1), path)
    assert annotations.read(spark, path).count() == 4
    clean = str(tmp_path / "clean")
    annotations.replace_clean(df, clean)
    annotations.replace_clean(df.limit(2), clean)
    assert annotations.read_clean(spark, clean, df.schema).count() == 2


GOOD = {"timestamp": "2024-05-01T10:00:00.123456", "evaluator": "zé", "approach_id": "a", "query": "o que é?", "result_id": "r",
        "result_type": "text", "result_page": 3, "result_score": 1, "evaluation": "relevante"}


def test_json_lines_skip_bad_and_blank_lines(spark, tmp_path):
    lines = [json.dumps(GOOD, ensure_ascii=False), "", "   ", "{broken", json.dumps({**GOOD, "result_score": 0.5, "timestamp": "bad"}),
             json.dumps({"query": "only"})]
    (tmp_path / "log.json").write_text("\n".join(lines) + "\n", encoding="utf-8")
    df = evaluations.read(spark, str(tmp_path / "log.json"))
    assert df.count() == 3  # also when no column is needed
    rows = df.collect()
    assert [r.result_score for r in rows] == [1.0, 0.5, None] and rows[0].evaluator == "zé"
    times = [r[0] for r in df.select(evaluations.event_time()).collect()]
    assert times[0].microsecond == 123456 and times[1] is None


def test_json_append_keeps_non_ascii(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([tuple(GOOD[f] if f != "result_score" else 1.0 for f in schemas.EVALUATION.fieldNames())], schemas.EVALUATION)
    evaluations.append(df, path)
    evaluations.append(df, path)
    assert evaluations.read(spark, path).count() == 2
    assert "o que é?" in next((tmp_path / "log").glob("part*.json")).read_text(encoding="utf-8")


def test_records_create_or_append(spark, tmp_path):
    path = str(tmp_path / "records")
    df = spark.createDataFrame([("q", "t", "Página 1", "s", [("u", 1)]), ("q", "t", "Página 2", "s", [])], schemas.RATING_RECORD)
    records.create_if_absent(df, path)
    records.create_if_absent(df, path)
    assert records.read(spark, path).count() == 2
    records.append(df, path)
    rows = records.read(spark, path).collect()
    assert len(rows) == 4 and sorted(len(r.responses) for r in rows) == [0, 0, 1, 1]


def test_vector_store(spark, tmp_path):
    path = str(tmp_path / "vectors")
    assert vectors.read(spark, path).count() == 0
    row = lambda a, i, t: ("d", i, 1, None, "o", "d", "k", "e", [1.0, 0.0], a, t)
    df = spark.createDataFrame([row("a1", "x", "text"), row("a1", "y", "image"), row("a2", "x", "text")], schemas.VECTOR_ITEM)
    vectors.write(df, path)
    vectors.replace_approach(spark.createDataFrame([row("a2", "z", "text")], schemas.VECTOR_ITEM), path, ["a2"])
    stored = vectors.read(spark, path)
    assert sorted((r.approach_id, r.id) for r in stored.collect()) == [("a1", "x"), ("a1", "y"), ("a2", "z")]
    assert vectors.read(spark, path, ["a1"]).count() == 2
    registry = spark.createDataFrame([("a1",), ("a2",), ("a3",)], "approach_id string")
    status = {r.approach_id: (r["items"], r.built) for r in vectors.build_status(stored, registry).collect()}
    assert status == {"a1": (2, True), "a2": (1, True), "a3": (0, False)}


def test_failures_of_a_build_are_counted(spark):
    rows = [("a", "text", [1.0, 0.0]), ("a", "text", [0.0, 0.0]), ("a", "image", None), ("b", "text", [-1.0, 1.0])]
    got = {(r.approach_id, r.type): (r["items"], r.failed) for r in vectors.failures(
        spark.createDataFrame(rows, "approach_id string, type string, vector array<float>")).collect()}
    assert got == {("a", "text"): (2, 1), ("a", "image"): (1, 1), ("b", "text"): (1, 0)}


def test_relative_paths(spark):
    forms = ["file:/data/images/x.png", "file:///data/images/x.png", "/data/images/x.png", "images/x.png", "hdfs://data/images/x.png"]
    df = spark.createDataFrame([(f,) for f in forms], "p string")
    assert {r[0] for r in df.select(pages.relative_path("p", "file:/data")).collect()} == {"images/x.png"}
    assert [r[0] for r in df.limit(1).select(pages.relative_path("p", "/other/")).collect()] == ["/data/images/x.png"]


def test_page_files(spark, tmp_path):
    (tmp_path / "cell_1.txt").write_text("é um\n\nbloco", encoding="utf-8")
    (tmp_path / "cell_12.txt").write_text("x", encoding="utf-8")
    rows = {(r.doc_id, r.page): r.text for r in pages.read_page_files(spark, str(tmp_path)).collect()}
    assert rows == {("cell", 1): "é um\n\nbloco", ("cell", 12): "x"}
    blocks = corpus.page_blocks(pages.read_page_files(spark, str(tmp_path)))
    assert blocks.filter("page = 1").count() == 3 and "doc_id" in blocks.columns


def test_registry_configuration(spark):
    got = approaches.with_configuration(spark.createDataFrame([("approach_2_hybrid_clip",), ("other",)], "approach_id string"))
    rows = {r.approach_id: r for r in got.collect()}
    assert rows["approach_2_hybrid_clip"].image_from == "fused" and rows["other"].image_from is None
    assert approaches.registry_table(spark).count() == 4
