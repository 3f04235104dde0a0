"""The lookup table by its own rule, and placement by it."""

import hashlib
from collections import Counter

import pytest

from folioscope.llm import queries, shards

SF = "/root/testdata/sf0.001"


def plain(names, slots):
    """Whole preference lists, one claim each in turn."""
    prefer = [[(shards._number("offset", s) % slots + j * (shards._number("step", s) % (slots - 1) + 1)) % slots for j in range(slots)] for s in names]
    table = [None] * slots
    at = [0] * len(names)
    while None in table:
        for i, order in enumerate(prefer):
            while at[i] < slots and table[order[at[i]]] is not None:
                at[i] += 1
            if at[i] < slots:
                table[order[at[i]]] = i
    return table


@pytest.mark.parametrize("n,slots", [(1, 2), (3, 7), (7, 7), (5, 101), (10, 997)])
def test_fill(n, slots):
    names = [f"s{i}" for i in range(n)]
    assert shards.fill(names, slots) == plain(names, slots)


def test_balance_weights_and_little_moves():
    names = [f"s{i}" for i in range(50)]
    table = shards.fill(names)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = shards.fill(names[:-1])
    moved = sum(a != b for a, b in zip(table, fewer) if a != 49)
    assert moved < 0.1 * len(table)
    heavy = Counter(shards.fill(["a", "b", "c"], 997, [2, 1, 0]))
    assert heavy[2] == 0 and abs(heavy[0] - 2 * heavy[1]) <= 2


@pytest.mark.parametrize("bad", [([], 7, None), (["a", "a"], 7, None), (["a"], 8, None), (["a"] * 2, 7, [1]), (["a", "b"], 7, [0, 0]), (["a", "b"], 7, [1, -1])])
def test_refused(bad):
    with pytest.raises(ValueError):
        shards.fill(*bad)


def test_place(spark, tmp_path):
    rows = [(1, "x"), (1, "y"), (None, "z"), (2 ** 62, "q"), (-5, None)]
    df = spark.createDataFrame(rows, "doc_id long, slot string")
    got = shards.place(df, "doc_id", ["a", "b", "c"], 101)
    assert got.columns == ["doc_id", "slot", "shard"]
    table = shards.fill(["a", "b", "c"], 101)
    for r in got.collect():
        key = "null" if r["doc_id"] is None else f"k{r['doc_id']}"
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, "abc"[table[slot]])
    assert shards.place(df.limit(0), "doc_id", ["a"], 3).count() == 0
    shards.write(got, str(tmp_path / "out"), files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select(got.columns).collect())) == sorted(map(str, got.collect()))


def test_query(spark):
    rows = queries.QUERIES["op8_shards"](spark, SF).collect()
    table = shards.fill(queries.SHARDS)
    assert len(rows) == 200
    for r in rows:
        slot = int(hashlib.md5(f"k{r['doc_id']}".encode()).hexdigest()[:15], 16) % shards.SLOTS
        assert (r["slot"], r["shard"]) == (slot, queries.SHARDS[table[slot]])
