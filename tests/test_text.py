import pytest
from pyspark.sql import functions as F

from folioscope import fixed_values as V
from folioscope.functions import text as X
from folioscope.operators import corpus, embedtext
from tests.conftest import plan

LONG = "x" * 60


def keep(spark, texts, mode="relevant", **kw):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return [r.text for r in corpus.keep_texts(df, mode, **kw).collect()]


def test_length_bounds_differ_by_mode(spark):
    texts = ["a" * n for n in (49, 50, 51)]
    assert keep(spark, texts) == texts[1:]
    assert keep(spark, texts, "length_only") == texts[2:]


def test_resume_is_an_anti_join_on_distinct_ids(spark):
    blocks = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "id string, doc_id int")
    done = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "id string, doc_id int")
    both = corpus.not_done(blocks, done)
    assert "LeftAnti" in plan(both) and sorted(r.id for r in both.collect()) == ["b", "c"]
    assert [r.id for r in corpus.not_done(blocks, done, keys=("id",)).collect()] == ["c"]


def test_a_filter_reads_cleaned_blocks_and_splits_once(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame([(1, "a\nb")], "page int, text string").write.parquet(path)
    text = plan(corpus.keep_texts(corpus.page_blocks(spark.read.parquet(path))))
    assert text.count("split(") == 1 and text.count("trim(") == 1


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        keep(spark, [LONG], "both")


@pytest.mark.parametrize("phrase", V.TEXT_STOP_PHRASES)
def test_stop_phrases_in_any_case(spark, phrase):
    assert keep(spark, [f"{LONG} {phrase.upper()} {LONG}"]) == []


def test_leaders(spark):
    nine, ten = f"{LONG}{'.' * 9}12", f"{LONG}{'.' * 10}12"
    mixed, apart = f"{LONG}. . . . . . 7", f"{LONG}{'.' * 30}a7"
    spaced = f"{LONG}{'.' * 8}     3"
    assert keep(spark, [nine, ten, mixed, apart, spaced]) == [nine, apart]


def test_a_very_long_leader_does_not_exhaust_the_stack(spark):
    assert keep(spark, [LONG + ". " * 20_000 + "7"]) == []
    assert len(keep(spark, [LONG + ". " * 20_000 + "x"])) == 1


def test_strip_takes_what_python_takes(one):
    for text in ["  a b \n", "  a\x1c", "\t\x0b", "", "a​ "]:
        assert one(X.strip("t"), t=text) == text.strip()


def test_one_line_turns_only_line_feeds(one):
    assert one(X.one_line(F.col("t")), t=" a\nb\tc\r\n") == "a b\tc"


def test_blocks_are_numbered_before_any_filter(spark):
    pages = spark.createDataFrame([(3, "first\n\n  third\nx ")], "page int, text string")
    rows = [(r.id, r.block_index, r.text) for r in corpus.page_blocks(pages).collect()]
    assert rows == [("p3_txt_0", 0, "first"), ("p3_txt_1", 1, ""), ("p3_txt_2", 2, "third"), ("p3_txt_3", 3, "x")]


def test_blocks_and_images_from_arrays(spark):
    pages = spark.createDataFrame([(1, ["a ", "b\nc"], ["i1", "i2"])], "page int, blocks array<string>, images array<string>")
    assert [r.text for r in corpus.block_rows(pages.drop("images")).collect()] == ["a", "b c"]
    images = corpus.image_rows(pages.drop("blocks")).collect()
    assert [(r.id, r.content_path) for r in images] == [
        ("p1_img_0", "images/p1_img_0.png"), ("p1_img_1", "images/p1_img_1.png")]


def test_separator_is_literal(spark):
    pages = spark.createDataFrame([(1, "a.b|c")], "page int, text string")
    assert corpus.page_blocks(pages, separator=".").count() == 2
    assert corpus.page_blocks(pages, separator="|").count() == 2


ANSWERS = [
    ("RESUMO: s PALAVRAS-CHAVE: a, b", "s", "a, b"),
    ("DESCRIÇÃO: d PALAVRAS-CHAVE: a", "d", "a"),
    ("RESUMO: s DESCRIÇÃO: d", "s DESCRIÇÃO: d", "N/A"),
    ("nothing", "N/A", "N/A"),
    ("", "N/A", "N/A"),
    ("RESUMO:", "", "N/A"),
    ("RESUMO: s PALAVRAS-CHAVE:", "s", ""),
    ("RESUMO: one RESUMO: two", "one", "N/A"),
    ("PALAVRAS-CHAVE: k RESUMO: s PALAVRAS-CHAVE: x", "s", "k RESUMO: s"),
    ("PALAVRAS-CHAVE: k RESUMO: s", "s", "k RESUMO: s"),
    ("RESUMO:\n s \n PALAVRAS-CHAVE: k ", "s", "k"),
]


@pytest.mark.parametrize("answer,summary,keywords", ANSWERS)
def test_parse(one, answer, summary, keywords):
    assert one(X.answer_summary("t"), X.answer_keywords("t"), t=answer) == (summary, keywords)


def test_parse_of_no_answer(one):
    assert one(X.answer_summary("t"), X.answer_keywords("t"), t=None) == (None, None)


def test_null_words_and_clean(spark):
    rows = [(str(i), "1", "text", w, "k") for i, w in enumerate([*V.NULL_WORDS, "NATO", "none", "N/A "])]
    rows += [("k", "1", "text", "d", None), ("ok", "2", "other", "d", "k")]
    df = spark.createDataFrame(rows, "id string, page string, type string, description_llm string, keywords_llm string")
    kept = corpus.clean(df).collect()
    assert [r.description_llm for r in kept] == ["NATO", "none", "N/A ", "d"]
    assert kept[-1].page == 2


def test_embedding_text(spark):
    df = spark.createDataFrame([("text", "d", "k"), ("image", "d", "k"), ("table", "d", "k")],
                               "type string, description_llm string, keywords_llm string")
    assert [r[0] for r in df.select(embedtext.embedding_text()).collect()] == [
        "Conteúdo sobre: d. Termos relacionados: k", "Imagem mostrando: d. Termos relacionados: k", ""]
    assert {r[0] for r in df.select(embedtext.embedding_text(V.TEMPLATE_UNIFIED)).collect()} == {
        "Descrição: d. Palavras-chave: k"}


def test_prompt_keeps_braces_of_the_text(spark):
    df = spark.createDataFrame([("a {} b",)], "text string")
    assert corpus.prompts(df, template="<{}>").first().prompt == "<a {} b>"
    assert "a {} b" in corpus.prompts(df).first().prompt
    assert corpus.image_prompts(df).first().prompt == V.IMAGE_PROMPT


def test_snippet_and_label(one):
    words = [f"w{i}" for i in range(60)]
    text = "  " + " \n\t".join(words) + " "
    assert one(X.first_words(F.col("t")), t=text) == " ".join(text.split()[:40])
    assert one(X.first_words(F.col("t")), t="one  two ") == "one two"
    assert one(X.first_words(F.col("t")), t="") == ""
    assert one(X.short_label("t"), t="ã" * 50) == "ã" * 40 + "..."
    assert one(X.short_label("t"), t="ab") == "ab..."


def test_tokens(one):
    assert one(X.tokens(F.col("t")), t="A célula-mãe É o_x 42 b, NÚCLEO!") == ["célula", "mãe", "o_x", "42", "núcleo"]


def test_ngrams(one):
    assert one(X.ngrams("w"), w=["a", "b", "c"]) == ["a b", "b c"]
    assert one(X.ngrams("w", (2, 3)), w=["a", "b", "c"]) == ["a b", "b c", "a b c"]
    assert one(X.ngrams("w"), w=["a"]) == []


def test_keyword_count(one):
    assert one(X.keyword_count("t"), t="a, b,c") == 3
    assert one(X.keyword_count("t"), t="") == 1
    assert one(X.keyword_count("t"), t=None) is None
