"""The pipeline against brute-force versions of its stages, each on its own input."""

import re

import duckdb
import public_tokenizers
import tiktoken

import corpus_pipeline
from folioscope.llm import byte_pairs, queries, surrogates
from tests.llm import test_decontaminate, test_near_dup, test_quality

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [[r.asDict() for r in docs.collect()]]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == columns
        kept.append([r.asDict() for r in docs.collect()])
    start, good, single, clean, private, ids = kept
    by = lambda rows: {r["doc_id"]: r for r in rows}

    # quality: nothing that fails the base stays, and what goes repeats itself or is short
    for r in start:
        base = test_quality.brute(r["text"]) if len(r["text"] or "") < 6000 else None
        if base and base["base_failed"]:
            assert r["doc_id"] not in by(good)
        if base and base["n_words"] >= 10 and not base["n_repeat_words"] and not base["n_dup_lines"]:
            assert r["doc_id"] in by(good)
    assert by(good).items() <= by(start).items() and 0 < len(good) < len(start)

    # near duplicates: the representatives of all pairs compared
    want = {i for i, _, _, stays in test_near_dup.brute([(r["doc_id"], r["text"]) for r in good], width=5) if stays}
    assert set(by(single)) == want and by(single).items() <= by(good).items()

    # decontamination: every window scanned
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    bad = {r[0] for r in test_decontaminate.brute([(r["doc_id"], r["text"]) for r in single], items) if r[-1]}
    assert bad and by(clean) == {i: r for i, r in by(single).items() if i not in bad}

    # personal data: gone from the texts, the rest as it was
    assert set(by(private)) == set(by(clean))
    found = 0
    for i, r in by(private).items():
        before, at = by(clean)[i]["text"], 0
        spans = surrogates.mentions(before)
        found += len(spans)
        assert all(before[a:b] not in r["text"] for a, b, _, _ in spans)
        outside = [before[x:y] for x, y in zip([0, *[b for _, b, _, _ in spans]], [*[a for a, _, _, _ in spans], len(before)])]
        assert re.fullmatch(".+?".join(map(re.escape, outside)), r["text"], re.S) and r["n_chars"] == len(r["text"])
    assert found

    # ids: those of the tokenizer library
    ranks = byte_pairs.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    judge = tiktoken.Encoding("judge", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r["doc_id"]: r["ids"] for r in ids} == {r["doc_id"]: judge.encode_ordinary(r["text"]) for r in private}

    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(by(ids))


def test_names():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and queries.QUERIES
