import numpy as np
import pandas as pd
import pytest

from folioscope import __main__ as cli, fixed_values as V, schemas
from folioscope.functions import encoders
from folioscope.plans import approaches, search as search_plan
from folioscope.sources import annotations as store, evaluations, records, vectors

LINE = "a long enough block about mitosis and the cell nucleus, part "


def annotator():
    return lambda prompt: f"RESUMO: about {prompt.split('part ')[1].split()[0]} PALAVRAS-CHAVE: a, b"


def models():
    words = encoders.encoder(encoders.hashed_words(16), 16)
    pixels = encoders.encoder(lambda: (lambda files: np.array([[float(len(f))] * 16 for f in files])), 16)
    return {V.TEXT_MODEL: approaches.Encoder(words, None, V.PASSAGE_PREFIX, V.QUERY_PREFIX, 16),
            V.JOINT_MODEL: approaches.Encoder(words, pixels, width=16)}


def test_jobs_from_pages_to_metrics(spark, tmp_path, capsys):
    p = lambda name: str(tmp_path / name)
    spark.createDataFrame([(i, f"{LINE}{i}\nshort") for i in range(1, 9)], "page int, text string").write.parquet(p("pages"))
    cli.main(["annotate", p("pages"), p("store"), "--annotator", f"{__name__}:annotator"])
    assert "8 annotations added, 0 failed" in capsys.readouterr().out
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "x.png").write_bytes(b"123")
    image = "images/x.png"  # as annotations name their files; the reader gives URIs
    store.append(spark.createDataFrame([(None, "p1_img_0", 1, "image", image, None, "a drawing", "cell")], schemas.ANNOTATION), p("store"))
    cli.main(["build", p("store"), p("vectors"), "--encoders", f"{__name__}:models", "--images", p("images")])
    assert vectors.read(spark, p("vectors")).count() == 36
    fused = vectors.read(spark, p("vectors"), [V.APPROACH_HYBRID]).filter("type = 'image'").first()
    assert np.linalg.norm(fused.vector) == pytest.approx(1)
    search_plan.fixed_queries(spark).write.parquet(p("queries"))
    cli.main(["search", p("queries"), p("vectors"), p("hits"), "--encoders", f"{__name__}:models"])
    hits = spark.read.parquet(p("hits"))
    assert hits.count() == 10 * 4 * (5 + 1)
    opened = search_plan.pages_to_open(search_plan.fixed_queries(spark), vectors.read(spark, p("vectors")), models())
    assert opened.count() == 40 and opened.filter("type = 'text' and snippet is null").count() == 0

    asked = search_plan.fixed_queries(spark)
    texts = search_plan.text_rating_records(asked, vectors.read(spark, p("vectors")), models())
    assert texts.count() == 50 and texts.columns == ["query", "result_text", "page", "score"]
    images = spark.createDataFrame([(image, bytearray(b"123"))], "content_path string, content binary")
    both = search_plan.multimodal_rating_records(asked, vectors.read(spark, p("vectors")), models(), images)
    assert both.filter("type = 'Imagem' and content like '<img%'").count() == 10 and both.count() == 60

    cli.main(["records", p("vectors"), p("rated"), "--encoders", f"{__name__}:models", "--queries", p("queries")])
    cli.main(["records", p("vectors"), p("rated"), "--encoders", f"{__name__}:models", "--queries", p("queries")])
    assert spark.read.json(p("rated")).count() == 50  # created once
    cli.main(["records", p("vectors"), p("rated2"), "--encoders", f"{__name__}:models", "--images", p("images")])
    assert spark.read.json(p("rated2")).filter("type = 'Imagem' and content like '<img%'").count() == 10
    cli.main(["build", p("store"), p("one"), "--encoders", f"{__name__}:models", "--approaches", V.APPROACH_TEXT_ONLY])
    assert [r.approach_id for r in vectors.read(spark, p("one")).select("approach_id").distinct().collect()] == [V.APPROACH_TEXT_ONLY]

    votes = [("2024-01-01T00:00:00", "ana", a.approach_id, "q", "r", "text", 1, 0.5, "relevante") for a in approaches.REGISTRY[:2]]
    evaluations.append(spark.createDataFrame(votes, schemas.EVALUATION), p("log"))
    cli.main(["judge", p("log")])
    out = capsys.readouterr().out
    assert out.count("100.00%") == 4 and out.count("0.000") >= 2

    records.append(spark.createDataFrame([("q", "t", "Página 1", "s", [("u1", 1)]), ("q", "t", "Página 2", "s", [])], schemas.RATING_RECORD), p("records"))
    spark.createDataFrame([("u1", "ana")], "id string, username string").write.parquet(p("users"))
    cli.main(["ratings", p("records"), p("users")])
    assert "Pendente" in capsys.readouterr().out


def test_profile_of_a_csv(spark, tmp_path):
    rows = [{"id": f"p{i}_txt_0", "page": i, "type": "text", "content_path": "", "original_text": "o", "description_llm": d, "keywords_llm": "x, y"}
            for i, d in enumerate(["célula animal grande", "célula animal", "N/A", "núcleo celular"], 1)]
    pd.DataFrame(rows).to_csv(tmp_path / "a.csv", index=False, encoding="utf-8-sig")
    cli.main(["profile", str(tmp_path / "a.csv"), str(tmp_path / "out")])
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name)).collect()
    assert read("pages")[0].pages == 4 and read("types")[0]["items"] == 3
    assert {r.ngram: r["items"] for r in read("bigrams")}["célula animal"] == 2
    assert {r.column: r["count"] for r in read("lengths")} == {"desc_len": 3, "kw_count": 3, "embed_len": 3}
    assert sum(r["items"] for r in read("length_histogram")) == 3
    assert len(list((tmp_path / "out").iterdir())) == 12
