"""Round trip of rendered conversations, masks against a scan of all tokens, and odd rows."""

import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest

from folioscope.llm import chat, queries

SF = "/root/testdata/sf0.001"
T = chat.Template()
PATH = public_tokenizers.path("byte_bpe_50k.json")


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
            len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_table(spark):
    want = {-1: [("user", queries.HARD), ("assistant", queries.HARD)]}
    for i, _, r, t in duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet' ORDER BY conv_id, turn").fetchall():
        want.setdefault(i, []).append((r or "", t or ""))
    rows = queries.QUERIES["op5_chat"](spark, SF).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in rows} == {i: digest(t) for i, t in want.items()}
    assert len(rows) == len(want)
    assert all(r["formatted_chars"] > 0 for r in rows)


def test_no_token_straddles_in_the_table(spark):
    rows = chat.formatted(spark.read.parquet(f"{SF}/conversations.parquet"), PATH).collect()
    ends = sum(len(r["spans"]) for r in rows)
    assert ends > 80
    for r in rows:
        edges = np.array([e for s in r["spans"] for e in (s["start"], s["end"])])
        starts, stops = np.array(r["starts"]), np.array(r["ends"])
        at = np.searchsorted(stops, edges, side="right")  # the first token that ends after the edge
        inside = at < len(starts)
        assert not (starts[at[inside]] < edges[inside]).any()


PIECES = [*T.controls, "\\", "<", ">", "[", "]", "/", "s", "INST", "<\\s>", "[\\\\/INST]", "é", " ", "\n", "漢", "🙂", "ok", "<|", "|>"]


@pytest.mark.parametrize("seed", range(3))
def test_round_trip_and_mask(seed):
    draw = random.Random(seed)
    text = lambda: "".join(draw.choice(PIECES) for _ in range(draw.randrange(12)))
    tokens = chat.tokenizer(PATH, T.controls)
    for _ in range(400):
        turns = [(draw.choice(["user", "assistant", text()]), text()) for _ in range(draw.randrange(5))]
        rendered, spans = T.render(turns)
        assert T.parse(rendered) == turns
        assert [T.unescape(rendered[a:b]) for a, b in spans] == [t for _, t in turns]
        assert all(T.unescape(T.escape(t)) == t and not any(c in T.escape(t) for c in T.controls) for _, t in turns)
        e = tokens.encode(rendered, add_special_tokens=False)
        offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
        wanted = [s for s, (r, _) in zip(spans, turns) if r == "assistant"]
        got = chat.mask(offsets[:, 0], offsets[:, 1], wanted)
        assert got.tolist() == [any(a < y and x < b for x, y in wanted) for a, b in e.offsets]
        cut = chat.masked_texts(rendered, offsets[:, 0], offsets[:, 1], got)
        assert [T.unescape(c) for c in cut] == [t for r, t in turns if r == "assistant" and t]
        # no token lies on a border of any turn
        assert not any(x < edge < y for a, b in spans for edge in (a, b) for x, y in e.offsets)
        assert tokens.decode(e.ids, skip_special_tokens=False) == rendered


def test_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, None, None), (1, 1, "assistant", "b"), (None, 0, "user", ""), (2, None, "assistant", " "),
            (2, 0, "assistant", "x" * 60_000), (3, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn int, role string, text string, ids string")
    got = {r["id"]: r for r in chat.read_back(chat.formatted(df, PATH)).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("", ""), ("assistant", "b"), ("assistant", "b")]
    assert got[1]["loss_texts"] == ["b", "b"] and got[None]["loss_texts"] == [] and got[3]["loss_texts"] == []
    assert got[2]["loss_texts"] == [" ", "x" * 60_000]
    assert chat.formatted(df.limit(0), PATH).count() == 0
