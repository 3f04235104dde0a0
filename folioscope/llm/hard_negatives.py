"""Hard negatives by an inverted multi-index.

Vectors are cut into two halves; each half has a codebook, and a pair of codewords is a
cell. Rows are stored packed by cell, in chunks of bounded size. An anchor orders the codewords of each half
by half score plus radius; a heap walks over pairs of codewords in order of the sum, which
no row of a cell exceeds. An anchor stops when that bound can change none of its results, so the results
are exact. Anchors go out in blocks of bounded size, each block passes over the packed rows
once for positives and once for the windows that these set, and of each task only the
best rows of an anchor come back.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F, types as T

from .shared import scratch, stored

SAMPLE = 20_000  # rows that the codebooks are fitted on, those with the smallest hash of their id
CODES = 16  # codewords per half
CHUNK = 4096  # rows per packed chunk
GROUP_BYTES = 32 << 20  # packed vectors searched together in a task
BLOCK_BYTES = 4 << 20  # vectors of anchors sent out together
BLOCK_ROWS = 8192
SCALE = 256


def participants(rows, id_col="vec_id", label_col="label", vector_col="embedding", scale=SCALE):
    """(id, label, vector): rows that take part, components as floor(scale * x).

    Rows with a null label or vector, or a null or non-finite component, take no part.
    """
    x = F.col("v")
    kept = rows.select(rows[id_col].alias("id"), rows[label_col].cast("long").alias("label"), rows[vector_col].cast("array<double>").alias("v"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return kept.where(F.col("label").isNotNull() & x.isNotNull() & finite).select("id", "label", F.transform(x, lambda c: F.floor(F.lit(scale).cast("double") * c)).alias("vector"))


def _matrix(column, width):
    """Rows of an Arrow list column as one matrix; shorter vectors end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def codebook(points, codes, rounds=12):
    """Centres of ``points`` by Lloyd's rounds from evenly spaced starts."""
    points = np.unique(points, axis=0)
    centres = points[np.linspace(0, len(points) - 1, min(codes, len(points))).astype(int)]
    for _ in range(rounds):
        near = _nearest(points, centres)
        for k in range(len(centres)):
            own = points[near == k]
            if len(own):
                centres[k] = own.mean(0)
    return centres


def _nearest(points, centres):
    return np.argmin((centres * centres).sum(1)[None, :] - 2 * points @ centres.T, axis=1)


def _kind(width, largest):
    """How vectors are packed, and whether their inner products are exact in doubles."""
    if largest and width and width * largest * largest >= 1 << 62:
        raise ValueError("inner products of these vectors do not fit 64 bits")
    return "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8"


class Index:
    """Packed rows, codebooks and what tasks need to know about both."""

    def __init__(self, rows, codes=CODES, sample=SAMPLE):
        """Store ``rows`` (id, label, vector; a table, since it is read several times) by cell."""
        self.spark = rows.sparkSession
        facts = rows.agg(F.max(F.size("vector")).alias("w"), F.max(F.coalesce(F.array_max("vector"), F.lit(0))).alias("hi"),
                         F.min(F.coalesce(F.array_min("vector"), F.lit(0))).alias("lo")).first()
        self.width = max(2, facts["w"] or 0)
        largest = max(abs(facts["hi"] or 0), abs(facts["lo"] or 0))
        self.kind = _kind(self.width, largest)
        self.exact = self.width * largest * largest < 1 << 53
        picked = rows.orderBy(F.xxhash64("id"), F.xxhash64("vector")).select("vector").limit(sample).toArrow()
        points = _matrix(picked.column(0).combine_chunks(), self.width).astype(np.float64) if picked.num_rows else np.zeros((1, self.width))
        half = self.width // 2
        self.books = codebook(points[:, :half], codes), codebook(points[:, half:], codes)
        self.path, self.chunks = scratch(self._packed(rows), "packed")

    def _packed(self, rows):
        """(a, b, n, ids, labels, vectors): up to about ``CHUNK`` rows of a cell, ids ascending."""
        books, width, kind = self.books, self.width, self.kind
        id_type = rows.schema["id"].dataType

        def placed(batches):
            half = width // 2
            for b in batches:
                m = _matrix(b.column(2), width)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:2], pa.array([r.tobytes() for r in m.astype(kind)], pa.binary()),
                     pa.array(_nearest(m[:, :half].astype(float), books[0]).astype(np.int32)), pa.array(_nearest(m[:, half:].astype(float), books[1]).astype(np.int32))],
                    names=["id", "label", "vector", "a", "b"])

        schema = T.StructType([rows.schema["id"], rows.schema["label"], T.StructField("vector", T.BinaryType()),
                               T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
        celled = stored(rows.select("id", "label", "vector").mapInArrow(placed, schema), "celled")
        # at most one row per cell
        sizes = stored(celled.groupBy("a", "b").agg(F.ceil(F.count("*") / CHUNK).alias("parts")), "sizes")
        parted = celled.join(F.broadcast(sizes), ["a", "b"]).withColumn("part", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), "parts"))

        def pack(key, table):
            table = table.sort_by("id")
            return pa.table({"a": pa.array([key[0].as_py()], pa.int32()), "b": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([table.num_rows], pa.int32()),
                             "ids": pa.array([table.column("id").to_pylist()], pa.list_(table.schema.field("id").type)),
                             "labels": pa.array([table.column("label").to_pylist()], pa.list_(pa.int64())),
                             "vectors": pa.array([b"".join(table.column("vector").to_pylist())], pa.binary())})

        schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("n", T.IntegerType()),
                               T.StructField("ids", T.ArrayType(id_type)), T.StructField("labels", T.ArrayType(T.LongType())), T.StructField("vectors", T.BinaryType())])
        return parted.groupBy("a", "b", "part").applyInArrow(pack, schema)


class _Group:
    """Chunks that a task searches together, with the radii of their codewords."""

    def __init__(self, chunks, books, width, kind, exact):
        half = width // 2
        self.books, self.half = books, half
        self.cells, self.radii = {}, [np.zeros(len(b)) for b in books]
        for c in chunks:
            m = np.frombuffer(c["vectors"], kind).reshape(c["n"], width)
            m = m.astype(np.float64 if exact else np.int64)
            for side, code in enumerate((c["a"], c["b"])):
                part = m[:, :half] if side == 0 else m[:, half:]
                far = np.sqrt(((part - books[side][code]) ** 2).sum(1).max())
                self.radii[side][code] = max(self.radii[side][code], far)
            self.cells.setdefault((c["a"], c["b"]), []).append((m, np.array(c["labels"]), c["ids"]))
        self.used = [np.array(sorted({k[i] for k in self.cells}), int) for i in (0, 1)]

    def sides(self, q):
        """For each half: codewords by falling bound, their upper and lower half scores."""
        out = []
        for side, part in enumerate((q[:self.half], q[self.half:])):
            codes = self.used[side]
            score = self.books[side][codes] @ part
            reach = self.radii[side][codes] * np.sqrt((part.astype(np.float64) ** 2).sum())
            # the slack is more than what doubles round off
            slack = 1e-9 * (np.abs(score) + reach) + 1e-6
            order = np.argsort(-(score + reach + slack), kind="stable")
            out.append((codes[order].tolist(), (score + reach + slack)[order].tolist(), (score - reach - slack)[order].tolist()))
        return out

    def walk(self, q):
        """(upper, lower, chunks) of the cells, by falling upper bound: the multi-sequence walk.

        A pair enters the heap when its two predecessors have left it. Empty cells are passed.
        """
        (x, up_x, low_x), (y, up_y, low_y) = self.sides(q)
        heap, done = [(-(up_x[0] + up_y[0]), 0, 0)], {}
        while heap:
            bound, i, j = heapq.heappop(heap)
            done[i] = j  # row i has left the heap up to column j
            if (cell := self.cells.get((x[i], y[j]))) is not None:
                yield -bound, low_x[i] + low_y[j], cell
            if j + 1 < len(y) and (i == 0 or done.get(i - 1, -1) >= j + 1):
                heapq.heappush(heap, (-(up_x[i] + up_y[j + 1]), i, j + 1))
            if i + 1 < len(x) and (j == 0 or done.get(i + 1, -1) >= j - 1):
                heapq.heappush(heap, (-(up_x[i + 1] + up_y[j]), i + 1, j))


def _best(scores, ids, k):
    """Positions of the first ``k`` by falling score, then rising id, null ids last."""
    order = sorted(range(len(scores)), key=lambda p: (-scores[p], ids[p] is None, ids[p] if ids[p] is not None else 0))
    return order[:k]


class _Found:
    """The best ``k`` rows of one window so far."""

    __slots__ = ("k", "low", "high", "rows")

    def __init__(self, k, low=None, high=None):
        self.k, self.low, self.high, self.rows = k, low, high, []

    @property
    def floor(self):
        """A score below this changes nothing."""
        last = self.rows[-1][0] if len(self.rows) == self.k else None
        return last if self.low is None else self.low if last is None else max(last, self.low)

    def add(self, scores, ids):
        """Rows of one chunk that fit the window; ids ascend, nulls last."""
        at = np.arange(len(scores))
        if self.high is not None:
            at = at[scores <= self.high]
        if (floor := self.floor) is not None:
            at = at[scores[at] >= floor]
        if not len(at):
            return
        if len(at) > self.k:  # of equal scores the first ids
            at = at[np.argsort(-scores[at], kind="stable")[:self.k]]
        rows = self.rows + [(int(scores[p]), ids[p]) for p in at]
        self.rows = [rows[p] for p in _best([r[0] for r in rows], [r[1] for r in rows], self.k)]


def _searched(index, anchors, windows_of, same_label, id_type):
    """(anchor, window, score, id): the best rows per anchor, window and task.

    ``anchors``: key, id, label, vector. ``windows_of(key)`` gives (k, low, high) for each window of an anchor.
    """
    books, width, kind, exact = index.books, index.width, index.kind, index.exact
    block = [(key, id_, label, np.asarray(vector, np.float64 if exact else np.int64), windows_of(key)) for key, id_, label, vector in anchors]
    block = [b for b in block if b[4]]
    sent = index.spark.sparkContext.broadcast(block)
    fields = [T.StructField("anchor", T.LongType()), T.StructField("window", T.IntegerType()), T.StructField("score", T.LongType()), T.StructField("id", id_type)]

    def searched(chunks, found):
        group = _Group(chunks, books, width, kind, exact)
        for key, own, label, q, _ in sent.value:
            goals = found[key]
            high = None if any(g.high is None for g in goals) else max(g.high for g in goals)
            for upper, lower, cell in group.walk(q):
                floors = [g.floor for g in goals]
                if all(f is not None and upper < f for f in floors):
                    break  # certified: no cell to come reaches any window
                if high is not None and lower > high:
                    continue
                for m, labels, ids in cell:
                    scores = (m @ q).astype(np.int64)
                    fits = labels == label if same_label else labels != label
                    least = None if None in floors else min(floors)
                    if least is not None:
                        fits &= scores >= least
                    if high is not None:
                        fits &= scores <= high
                    at = np.flatnonzero(fits)
                    if same_label:
                        at = np.array([p for p in at if ids[p] != own], int) if len(at) <= 64 else at[[ids[p] != own for p in at]]
                    if len(at):
                        picked, names = scores[at], [ids[p] for p in at]
                        for g in goals:
                            g.add(picked, names)

    def run(batches):
        found = {key: [_Found(*w) for w in windows] for key, _, _, _, windows in sent.value}
        chunks, held = [], 0
        for b in batches:
            for row in b.to_pylist():
                chunks.append(row)
                held += len(row["vectors"])
                if held >= GROUP_BYTES:
                    searched(chunks, found)
                    chunks, held = [], 0
        if chunks:
            searched(chunks, found)
        rows = [(key, w, score, id_) for key, goals in found.items() for w, g in enumerate(goals) for score, id_ in g.rows]
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(columns[0]), pa.int64()), pa.array(list(columns[1]), pa.int32()), pa.array(list(columns[2]), pa.int64()),
                                          pa.array(list(columns[3]), id_arrow)], names=["anchor", "window", "score", "id"])

    id_arrow = _arrow_type(id_type)
    rows = index.chunks.mapInArrow(run, T.StructType(fields))
    k = max((w[0] for b in block for w in b[4]), default=1)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _arrow_type(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _blocks(anchors, width):
    """The anchors as lists of bounded size, numbered through."""
    rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(1, 8 * width)))
    total = anchors.count()
    if not total:
        return
    numbered = stored(anchors.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-total // rows)))), "anchors")
    first = 0
    for k in range(-(-total // rows)):
        got = numbered.where(F.col("block") == k).orderBy("id").collect()  # about ``rows`` anchors
        yield [(first + i, r["id"], r["label"], r["vector"] + [0] * (width - len(r["vector"]))) for i, r in enumerate(got)]
        first += len(got)


def mine(rows, is_anchor, positives=5, negatives=10, low=30, high=90, codes=CODES, sample=SAMPLE):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` are (id, label, vector) of integers, those where ``is_anchor`` holds are anchors. A row's score is its inner
    product with the anchor, higher first, equal scores by smaller id, a null id last. The positives of an anchor
    are its first rows of the same label under other ids. For each, the first rows of other labels are
    returned whose score is ``low`` to ``high`` percent of the positive's. Rows or anchors that repeat an id count
    each; a shorter vector counts as ending in zeros. Without rows, anchors, positives or
    negatives there is nothing to return.
    """
    rows = stored(rows, "rows")
    index = Index(rows, codes, sample)
    spark, id_type = rows.sparkSession, rows.schema["id"].dataType
    out = None
    for block in _blocks(rows.where(is_anchor), index.width):
        ids = {key: id_ for key, id_, _, _ in block}
        near = _searched(index, block, lambda key: [(positives, None, None)], True, id_type).collect()  # at most ``positives`` per anchor
        aims = {}
        for r in near:
            aims.setdefault(r["anchor"], {})[r["rank"] - 1] = (r["id"], r["score"])

        def windows(key):
            got = aims.get(key, {})
            # low * p <= 100 * n <= high * p in whole numbers; an empty window finds nothing
            return [(negatives, -(-low * got[k][1] // 100), high * got[k][1] // 100) for k in sorted(got)]

        found = _searched(index, block, windows, False, id_type)
        names = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("window", T.IntegerType()), T.StructField("anchor_id", id_type),
                              T.StructField("positive_id", id_type), T.StructField("positive_score", T.LongType())])
        aimed = spark.createDataFrame([(key, w, ids[key], p, s) for key, got in aims.items() for w, (p, s) in got.items()], names)
        part = stored(found.join(aimed, ["anchor", "window"]).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "mined")
        out = part if out is None else out.union(part)
    if out is None:
        kind = id_type.simpleString()
        return spark.createDataFrame([], f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long")
    return out
