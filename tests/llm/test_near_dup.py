"""Near-duplicate groups against all pairs of full sets."""

import random
import re
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import arrow, components, near_dup, quality, shared

SF = "/root/testdata/sf0.001"


def sets(text, width):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(docs, width=4, percent=80):
    shingles = {i: sets(t, width) for i, t in docs}
    root = {i: i for i in shingles}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(shingles)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            inter = len(shingles[a] & shingles[b])
            if inter and 100 * inter >= percent * len(shingles[a] | shingles[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(shingles[i]), find(i), find(i) == i) for i in ids)


def check(spark, docs, **more):
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, id int").repartition(3)
    got = near_dup.grouped(df, **more)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == brute(docs, **more)


def test_the_table(spark):
    check(spark, duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("seed", [1, 2])
def test_edited_copies(spark, seed):
    """Chains of edits: groups whose members are not all similar, and buckets with several groups."""
    draw = random.Random(seed)
    docs = []
    for _ in range(6):
        words = [f"w{draw.randrange(3000)}" for _ in range(draw.choice([6, 30, 120]))]
        for _ in range(30):
            docs.append(" ".join(words))
            for _ in range(draw.randrange(1 + len(words) // 25)):
                words[draw.randrange(len(words))] = f"n{draw.randrange(10 ** 6)}"
            if draw.random() < 0.1:
                docs.append(docs[-1].upper())
    docs += [" ".join(f"q{draw.randrange(9)}" for _ in range(draw.randrange(1, 6))) for _ in range(80)]
    draw.shuffle(docs)
    check(spark, list(enumerate(docs)))


def template_families(draw, heavy=400, pairs=12):
    """Pairs at 0.8 and more, each among many texts that share a template with them but are not similar."""
    words = [f"w{i}" for i in range(400)]

    def edited(text, n):
        out = list(text)
        for k in draw.sample(range(len(out)), n):
            out[k] = f"n{draw.randrange(10 ** 9)}"
        return out

    docs = [" ".join(edited(words, 40)) for _ in range(heavy)]
    for _ in range(pairs):
        light = edited(words, 30)
        docs += [" ".join(edited(light, 4)), " ".join(edited(light, 4))]
    draw.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("family,pure", [(512, 64), (9, 4), (40, 2)])
def test_similar_pairs_in_crowded_buckets(spark, monkeypatch, family, pure):
    """No pivot need be one of the pair: what the pivots leave in a bucket is compared in full."""
    monkeypatch.setattr(near_dup, "FAMILY", family)
    monkeypatch.setattr(near_dup, "PURE", pure)
    check(spark, template_families(random.Random(6)))


def test_a_block_is_one_row_of_a_meeting(spark, monkeypatch):
    """What goes into the meetings grows with the blocks that meet, not with their members."""
    seen, own = [], near_dup._joined

    def counted(meetings, *args):
        seen.append((meetings.count(), meetings.select("u", "v").distinct().count()))
        return own(meetings, *args)

    monkeypatch.setattr(near_dup, "_joined", counted)
    check(spark, template_families(random.Random(6)))
    assert any(met for _, met in seen) and all(rows <= 2 * met for rows, met in seen)


def test_pairs_never_become_rows(spark, monkeypatch):
    """Many texts at just under 0.8 to each other: the links that leave the tasks join groups, and are fewer than the members."""
    seen, own = [], near_dup._joined

    def counted(*args):
        out = own(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "_joined", counted)
    monkeypatch.setattr(near_dup, "FAMILY", 50)
    draw = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(300):
        text = list(words)
        for k in draw.sample(range(200), draw.choice([4, 6, 8])):
            text[k] = f"n{i}x{k}"
        docs.append((i, " ".join(text)))
    check(spark, docs)
    assert sum(seen) < 300


def test_small_tables_are_few_files(spark, monkeypatch):
    """Tables of ids and numbers get as many files as their rows are worth, not one for each partition of a shuffle."""
    files, own = {}, shared.scratch

    def counted(df, name):
        path, table = own(df, name)
        files.setdefault(name, []).append(len(table.inputFiles()))
        return path, table

    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    monkeypatch.setattr(shared, "scratch", counted)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        check(spark, template_families(random.Random(6)))
        components.of(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    small = {"shared", "members", "pivots", "pairs", "edges", "least", "components", "held", "crowded", "crowd", "family", "sizes", "blocks", "present", "of_class"}
    assert small <= set(files)
    assert max(max(files[name]) for name in small) <= spark.sparkContext.defaultParallelism


def test_rows_worth_more_files(spark, monkeypatch):
    """Nor do tables of many rows go through fewer tasks than their rows are worth."""
    monkeypatch.setattr(shared, "FILE_ROWS", 10)
    df = spark.range(100).repartition(16, "id")
    assert len(shared.stored(df, rows=90).inputFiles()) == 9
    table = shared.stored(df, rows=10)
    assert len(table.inputFiles()) == spark.sparkContext.defaultParallelism and table.count() == 100


def test_intersections():
    draw = np.random.default_rng(5)
    sets = [set(draw.choice(60, draw.integers(0, 40), replace=False).tolist()) | {1000 + i} for i in range(30)]
    rows = np.array([i for i, s in enumerate(sets) for _ in s])
    names = np.array([x for s in sets for x in s], np.uint64)
    want = np.array([[len(a & b) for b in sets] for a in sets])
    for wide in (4096, 7):
        near_dup.WIDE = wide
        got = near_dup.intersections(rows, names, 30, 30)
        assert (got - np.diag(np.diag(got)) == want - np.diag(np.diag(want))).all()
        assert (near_dup.intersections(rows, names, 30, 11) == want[:11, 11:]).all()
    near_dup.WIDE = 4096


def test_odd(spark):
    check(spark, list(enumerate([None, "", " ", "a", "A", "a b c", "a  b\nc", "a b c d", "a b c d", "x " * 5000, "x " * 5, "É", "é"])))
    df = spark.createDataFrame([(None, "a b"), (None, "A b"), (5, "a b"), (5, "a b"), (9, "A B"), (None, "q"), (None, "Q"), (None, None), (None, ""), (7, None), (7, None)], "doc_id long, text string")
    got = sorted(map(tuple, near_dup.grouped(df).collect()), key=str)
    assert [r for r in got if r[0] is not None or r[2] is not None] == sorted(
        [(None, 1, 5, False)] * 2 + [(5, 1, 5, True)] * 2 + [(9, 1, 5, False)] + [(7, 0, 7, True)] * 2, key=str)
    assert sorted(r for r in got if r[0] is None and r[2] is None) == [(None, 0, None, True)] * 2 + [(None, 1, None, False), (None, 1, None, True)]
    assert near_dup.grouped(df.limit(0)).count() == 0
    kept = [tuple(r) for r in near_dup.representatives(df).collect()]
    assert sorted(kept, key=str) in [sorted([(5, "a b"), (None, q), (None, None), (None, ""), (7, None)], key=str) for q in ("q", "Q")]


def test_two_texts_under_one_id(spark):
    """Each row is judged by its own text."""
    words = [f"w{i}" for i in range(101)]
    docs = [(1, "another text altogether " * 9), (1, " ".join(words)), (2, " ".join(words[1:])), (3, " ".join(words[:50])), (3, " ".join(words[2:]))]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, __node0 string, n int")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_dup.grouped(df).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 3, True)]
    kept = near_dup.representatives(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([docs[0], docs[1], docs[3]])


def test_ids_that_are_texts(spark):
    df = spark.createDataFrame([("b", "one two three"), ("a", "one two three"), (None, "one two three")], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in near_dup.grouped(df).collect()) == [("None", "a", False), ("a", "a", True), ("b", "a", False)]


def test_signature_is_the_minimum_over_all_levels():
    names = near_dup.mix(np.arange(1, 8, dtype=np.uint64) * np.uint64(977))
    rows = np.array([0, 0, 0, 1, 2, 2, 2])
    got = near_dup.signatures(rows, names, 3, slots=16)
    want = np.full((3, 16), np.inf)
    for row, name in zip(rows, names):
        order = list(range(16))
        for level in range(16):
            r, y = near_dup._draw(np.array([name]), level)
            k = level + int(y[0] % np.uint64(16 - level))
            order[level], order[k] = order[k], order[level]
            want[row, order[level]] = min(want[row, order[level]], r[0] + level)
    assert (got == want).all()


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(3)
    x = draw.integers(0, 2 ** 63, 2000).astype(np.uint64)
    names = np.concatenate([x[:1500], x[500:]])
    got = near_dup.signatures(np.repeat([0, 1], 1500), names, 2)
    assert abs((got[0] == got[1]).mean() - 0.5) < 0.15


def test_components(spark):
    draw = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, 200 + i) for i in range(1, 50)] + [(draw.randrange(40), draw.randrange(40)) for _ in range(30)]
    got = dict(map(tuple, components.of(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


def peak_mb(run):
    """What ``run`` gives and the memory it took at most, NumPy's arrays included."""
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def prose(draw, n, size):
    return [" ".join(f"word{draw.randrange(5000)}" for _ in range(size)) for _ in range(n)]


@pytest.mark.parametrize("step", ["signatures", "quality"])
def test_a_worker_takes_little_memory(spark, monkeypatch, step):
    """Texts of 4 MB take a worker less than 60 MB: it keeps what it took, and two of them share an executor with its JVM."""
    module = near_dup if step == "signatures" else quality
    caught = []
    monkeypatch.setattr(module, "over_texts", lambda df, text, work, schema, limit=arrow.CHUNK_BYTES: caught.append((text, work, limit)) or df)
    docs = spark.createDataFrame([], "id long, text string")
    near_dup.signed(docs, "id", "text", 5) if step == "signatures" else quality.passing(docs)
    (text, work, limit), = caught
    rows = pa.RecordBatch.from_pydict({"id": list(range(2000)), "text": prose(random.Random(1), 2000, 240)})
    got, peak = peak_mb(lambda: sum(work(piece).num_rows for piece in arrow.pieces(rows, text, limit)))
    assert got == 2000 and peak < 60


def test_a_meeting_takes_little_memory():
    """Two blocks of the largest size: texts of 3.6 MB, compared in full."""
    class Meetings:
        def groupBy(self, *keys):
            return self

        def applyInArrow(self, meet, schema):
            return meet

    draw = random.Random(2)
    texts = prose(draw, 1024, 390)
    texts[700] = texts[3] + " and more"
    texts[900] = texts[900][:700] + " " + texts[5][700:]
    members = [{"id": {"id": i}, "group": {"id": i}, "text": t} for i, t in enumerate(texts)]
    rows = pa.table({"u": [1, 1], "v": [2, 2], "block": [2, 1], "members": [members[512:], members[:512]]})
    meet = near_dup._joined(Meetings(), "long", 5, True, 80)
    got, peak = peak_mb(lambda: meet((pa.scalar(1), pa.scalar(2)), rows))
    want = {(a, b) for a, b in [(3, 700), (5, 900)] if 100 * len(sets(texts[a], 5) & sets(texts[b], 5)) >= 80 * len(sets(texts[a], 5) | sets(texts[b], 5))}
    assert {(r["a"]["id"], r["b"]["id"]) for r in got.to_pylist()} == want and (3, 700) in want
    assert peak < 100
