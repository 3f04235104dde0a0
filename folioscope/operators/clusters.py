"""Exact top-k that leaves out clusters of vectors which cannot matter.

Items get three plain columns: the cluster, the angle to the cluster's pivot, and whether the item is the
pivot itself. The largest angle is the cluster's radius, so the store needs no index besides. An item in a cluster is at
least as far from a query as the pivot, less the radius; the cosine of that angle bounds its score. A query first
searches the clusters that come first by this bound, then those whose bound reaches its k-th score so far. Both
steps are the usual search with the cluster as a group, which reads the folders of the named clusters only.
"""

from pyspark.sql import DataFrame, Window, functions as F, types as T

from .. import fixed_values as V
from ..session import stored
from . import search

PIVOTS = 64  # clusters per group
SAMPLE = 4096  # items per group that pivots are chosen from, those with the smallest hash of their id
NO_DIRECTION = -1  # the cluster of zero vectors, whose score is 0 for every query
SLACK = 2e-6  # rounding of scores and of angles
COLUMNS = (("cluster", T.IntegerType()), ("pivot_angle", T.DoubleType()), ("is_pivot", T.BooleanType()))


def _directions(column):
    """(unit vectors, has a direction) of a list column; rows that are no vectors have none and become zeros."""
    import numpy as np

    rows = column.to_pylist()
    width = max((len(r) for r in rows if r is not None), default=1)
    matrix = np.zeros((len(rows), width))
    sound = np.zeros(len(rows), bool)
    for i, r in enumerate(rows):
        if r is not None and None not in r:
            matrix[i, :len(r)] = r
            sound[i] = np.isfinite(matrix[i]).all()
    matrix[~sound] = 0
    return search._unit(matrix), sound, np.abs(matrix).max(1) > 0


def _spread_out(matrix, count):
    """Positions of rows far from each other: each next one is the farthest from all before."""
    import numpy as np

    chosen, near = [0], matrix @ matrix[0]
    while len(chosen) < min(count, len(matrix)):
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-9:
            break  # only copies are left
        chosen.append(far)
        near = np.maximum(near, matrix @ matrix[far])
    return chosen


def clustered(items: DataFrame, by=(), id_col="id", vector="vector", pivots=PIVOTS, sample=SAMPLE) -> DataFrame:
    """``items`` (a table, since it is read twice) with the columns of ``COLUMNS``, clustered within each group of ``by``.

    Pivots are chosen from a bounded sample; every item is put to its nearest pivot, in one pass without a shuffle.
    Items without a vector have no cluster.
    """
    import numpy as np

    by = list(by)
    order = Window.partitionBy(*by).orderBy(F.xxhash64(id_col), id_col)
    some = items.filter(F.col(vector).isNotNull()).select(*by, id_col, vector).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= sample)
    table, groups = some.toArrow(), {}
    keys = list(zip(*[table.column(c).to_pylist() for c in by])) if by else [()] * table.num_rows
    unit, _, has = _directions(table.column(vector)) if table.num_rows else (np.zeros((0, 1)), None, np.zeros(0, bool))
    names = table.column(id_col).to_pylist()
    for key in set(keys):
        rows = [i for i, x in enumerate(keys) if x == key and has[i]]
        if rows:
            rows = [rows[p] for p in _spread_out(unit[rows], pivots)]
            groups[key] = (unit[rows], [names[i] for i in rows])
    sent = items.sparkSession.sparkContext.broadcast(groups)  # at most ``pivots`` vectors per group
    schema = T.StructType([*items.schema.fields, *[T.StructField(n, t) for n, t in COLUMNS]])
    at = {c: items.columns.index(c) for c in [*by, id_col, vector]}

    def place(batches):
        import pyarrow as pa

        for b in batches:
            matrix, sound, some = _directions(b.column(at[vector]))
            cluster = np.where(sound, NO_DIRECTION, 0).astype(np.int32)
            angle, pivot = np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            own = list(zip(*[b.column(at[c]).to_pylist() for c in by])) if by else [()] * b.num_rows
            ids = b.column(at[id_col]).to_pylist()
            for key in set(own):
                rows = np.array([i for i, x in enumerate(own) if x == key and some[i]], int)
                if key not in sent.value or not len(rows):
                    continue
                centres, first = sent.value[key]
                near = matrix[rows] @ centres.T
                cluster[rows] = near.argmax(1)
                angle[rows] = np.arccos(np.clip(near.max(1), -1, 1))
                pivot[rows] = [ids[i] == first[c] for i, c in zip(rows, cluster[rows])]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(cluster, mask=~sound), pa.array(angle, mask=~sound), pa.array(pivot)], names=schema.fieldNames())

    return items.mapInArrow(place, schema)


def _bounds(summary, by, vector):
    """{group: (clusters, pivot vectors, radii, sizes)} from the rows of ``summary``."""
    import numpy as np

    groups = {}
    for r in summary:
        groups.setdefault(tuple(r[c] for c in by), []).append(r)
    out = {}
    for key, rows in groups.items():
        width = max((len(r["pivot"]) for r in rows if r["pivot"] is not None), default=1)
        centres = np.array([r["pivot"] if r["pivot"] is not None else [0.0] * width for r in rows], float)
        out[key] = ([r["cluster"] for r in rows], search._unit(centres), np.array([r["radius"] for r in rows]), np.array([r["n"] for r in rows]))
    return out


def top_k(items: DataFrame, queries: DataFrame, k=V.TOP_K, by=(), id_col="id", vector="vector", query_id="query_id", keep=(), fetch=(),
          digits=6, key=(), report=None) -> DataFrame:
    """The answers of ``search.top_k`` from ``clustered`` items. ``report``, a dict, gets the shares of rows opened and of pairs scored."""
    import numpy as np

    by, spark = list(by), items.sparkSession
    queries = stored(queries.select(*by, query_id, vector).filter(F.col(vector).isNotNull()), "queries")
    sums = items.filter(F.col("cluster").isNotNull()).groupBy(*by, "cluster").agg(
        F.max("pivot_angle").alias("radius"), F.count("*").alias("n"),
        F.first(F.when(F.col("is_pivot"), F.col(vector)), ignorenulls=True).alias("pivot"))
    # one row per cluster
    sent = spark.sparkContext.broadcast(_bounds(sums.collect(), by, vector))
    fields = [queries.schema[c] for c in [*by, query_id, vector]]
    schema = T.StructType([*fields, T.StructField("cluster", T.IntegerType()), T.StructField("turn", T.IntegerType())])

    def chosen(rows, turn):
        """The clusters that a query searches in a turn; in the second it knows its k-th score, ``floor``."""
        names = [*by, query_id, vector]

        def run(batches):
            import pyarrow as pa

            for b in batches:
                unit, _, some = _directions(b.column(vector))
                floors = b.column("floor").to_pylist() if turn == 2 else [None] * b.num_rows
                own = list(zip(*[b.column(c).to_pylist() for c in by])) if by else [()] * b.num_rows
                take, which = [], []
                for i, group in enumerate(own):
                    if group not in sent.value:
                        continue
                    clusters, centres, radii, sizes = sent.value[group]
                    bound = np.zeros(len(clusters))
                    led = np.array(clusters) != NO_DIRECTION
                    if some[i] and led.any():
                        if centres.shape[1] != unit.shape[1]:
                            raise ValueError(f"query width {unit.shape[1]}, item width {centres.shape[1]}")
                        theta = np.arccos(np.clip(centres[led] @ unit[i], -1, 1))
                        bound[led] = np.cos(np.maximum(theta - radii[led], 0))
                    order = np.argsort(-bound, kind="stable")
                    first = int(np.searchsorted(np.cumsum(sizes[order]), k)) + 1
                    if turn == 1:
                        picked = order[:first]
                    else:
                        rest = order[first:]
                        picked = rest if floors[i] is None else rest[bound[rest] + SLACK >= floors[i]]
                    take += [i] * len(picked)
                    which += [clusters[c] for c in picked]
                rows = b.select(names).take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(which, pa.int32()), pa.array([turn] * len(which), pa.int32())], names=schema.fieldNames())

        return stored(rows.mapInArrow(run, schema), "chosen")

    def answered(asked):
        found = search.top_k(items, asked, k=k, by=[*by, "cluster"], id_col=id_col, vector=vector, query_id=query_id, keep=keep, digits=digits, key=key)
        return stored(found.drop("rank"), "found")

    order = Window.partitionBy(*by, query_id).orderBy(F.desc("score"), F.asc(id_col), *[F.asc(c) for c in key])
    one = chosen(queries, 1)
    first = answered(one)
    last = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select(*by, query_id, F.col("score").alias("floor"))
    known = queries.join(last, [*by, query_id], "left") if by or query_id else queries
    two = chosen(known, 2)
    second = answered(two)
    if report is not None:
        sizes = stored(sums.select(*by, "cluster", "n"), "sizes")
        total, asked = sizes.agg(F.sum("n")).first()[0] or 0, one.unionByName(two)
        opened = sizes.join(asked.select(*by, "cluster").distinct(), [*by, "cluster"], "left_semi").agg(F.sum("n")).first()[0] or 0
        of_group = sizes.groupBy(*by).agg(F.sum("n").alias("n"))
        pairs = asked.join(sizes, [*by, "cluster"]).agg(F.sum("n")).first()[0] or 0
        every = (queries.join(of_group, by) if by else queries.withColumn("n", F.lit(total))).agg(F.sum("n")).first()[0] or 0
        report.update(rows_opened=opened / total if total else 0.0, pairs_scored=pairs / every if every else 0.0)
    hits = first.unionByName(second).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if fetch:
        hits = search.fetched(stored(hits, "hits"), items, fetch, [*by, *key, id_col])
    return hits.select(*by, query_id, "rank", id_col, "score", *keep, *fetch)
