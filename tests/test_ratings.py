import base64

from pyspark.sql import functions as F

from folioscope.operators import ratings
from folioscope.session import stored

RECORDS = "query string, result_text string, page string, score string, responses array<struct<user_id:string,value:int>>"


def records(spark):
    return spark.createDataFrame([
        ("q1", "t1", "Página 1", "s", [("u1", 1), ("u2", 0)]),
        ("q1", "t2", "Página 2", "s", []),
        ("q2", "t3", "Página 3", "s", None),
        ("q2", "t4", "Página 4", "s", [("u1", 0), ("u3", 1)]),
    ], RECORDS)


def users(spark):
    return spark.createDataFrame([("u1", "ana"), ("u2", "rui"), ("u3", "ana")], "id string, username string")


def test_flatten_keeps_unrated_records(spark):
    rows = ratings.flatten(records(spark), users(spark)).collect()
    got = sorted((r.result_text, r.user, r.value, r.relevancia) for r in rows)
    assert got == [("t1", "ana", 1, "1"), ("t1", "rui", 0, "0"), ("t2", "N/A", None, "Pendente"),
                   ("t3", "N/A", None, "Pendente"), ("t4", "ana", 0, "0"), ("t4", "ana", 1, "1")]
    assert ratings.completed(ratings.flatten(records(spark), users(spark))).count() == 4


def test_overall_and_by_user(spark):
    row = ratings.overall(records(spark)).first()
    assert (row.precision, row.ratings) == (0.5, 4)
    got = {r.user: (r.precision, r.ratings) for r in ratings.by_user(records(spark), users(spark)).collect()}
    assert got == {"ana": (2 / 3, 3), "rui": (0.0, 1)}


def test_nothing_rated(spark):
    row = ratings.overall(records(spark).filter("result_text = 't2'")).first()
    assert (row.precision, row.ratings) == (None, 0)


def test_domain_is_a_split(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (-1,), (None,)], "value int")
    ok, rejected = ratings.split_domain(df)
    assert sorted(r.value for r in ok.collect()) == [0, 1] and rejected.count() == 3


HITS = "query string, type string, rank int, id string, score double, page int, text_for_embedding string, content_path string"


def test_text_records(spark):
    hits = spark.createDataFrame([("q", "text", 1, "a", 0.98765, 7, "t", None)], HITS)
    assert tuple(ratings.text_records(hits).first()) == ("q", "t", "Página 7", "Score: 0.9877")


def test_multimodal_records(spark):
    hits = spark.createDataFrame([("q", "text", 1, "a", 0.9, 7, "t", None), ("q", "image", 1, "b", 0.9, 7, "i", "p1"),
                                  ("q", "image", 2, "c", 0.9, 7, "j", "p2"), ("q", "image", 3, "d", 0.9, 7, "k", "p3")], HITS)
    data = bytes(range(256))
    images = spark.createDataFrame([("p1", data), ("p3", None), ("p9", data)], "content_path string, content binary")
    for shown in (hits, stored(hits)):
        rows = {r.content for r in ratings.multimodal_records(shown, images).collect()}
        tag = f'<img src="data:image/png;base64,{base64.b64encode(data).decode()}" width="200">'
        missing = "<i>Imagem não encontrada</i>"
        assert rows == {"t", f"{tag}<br><br><b>Descrição:</b> i", f"{missing}<br><br><b>Descrição:</b> j",
                        f"{missing}<br><br><b>Descrição:</b> k"}
