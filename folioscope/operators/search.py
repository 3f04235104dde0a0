"""Exact top-k inner-product search for whole tables of queries.

Scoring is a matrix product per Arrow batch, so only the best ``k`` items per query
and task ever leave a task: no pair of query and item is materialised. A table of few queries travels
to the tasks. Many queries are dealt into chunks, as the items are, and a task takes a chunk of either; the
driver holds none of them.
"""

import math


from pyspark.sql import DataFrame, Window, functions as F, types as T

from .. import fixed_values as V
from ..functions import text as X
from ..session import stored

MAX_SENT_QUERIES = 65_536
MAX_SENT_BYTES = 64 << 20
MAX_SENT_HITS = 1_000_000
CHUNK_BYTES = 32 << 20  # vectors of a chunk of items or of queries
LEAST_CHUNK = 1024  # items, so that a small table still gives work to all cores
_SCORES_AT_ONCE = 4_000_000
_CROWD = 8  # times k: more candidates of a query in a block are scored with the block
_MAXIMA_OF = 16  # columns


def _unit(matrix):
    import numpy as np

    length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    length[length == 0] = 1.0
    return matrix / length[:, None]


def _rounded(scores, digits):
    """Half away from zero; equal vectors get equal scores wherever they are read."""
    import numpy as np

    if digits is None:
        return scores
    scale = 10.0 ** digits
    return np.sign(scores) * np.floor(np.abs(scores) * scale + 0.5) / scale + 0.0


def _maxima(scores, k):
    """Per row the maxima over few columns each; a maximum's columns are its own place and those ``width`` apart.

    At least ``k`` columns reach the k-th best maximum, so it is as good a limit as the k-th best score, and is found faster.
    """
    import numpy as np

    n = scores.shape[1]
    apart = max(1, min(_MAXIMA_OF, n // (8 * k)))
    width = n // apart
    tops = scores[:, :apart * width].reshape(len(scores), apart, width).max(axis=1)
    for start in range(apart * width, n, width):
        rest = scores[:, start:start + width]
        tops[:, :rest.shape[1]] = np.maximum(tops[:, :rest.shape[1]], rest)
    return tops


def _crowded(queries, items, bar, k, slack, digits):
    """(query position, item position, score) as of ``_candidates``, from scores in double of all pairs."""
    import numpy as np

    scores = queries @ items.T
    n = scores.shape[1]
    if n > k:
        bar = np.maximum(bar, _rounded(np.partition(scores, n - k, axis=1)[:, n - k], digits))
    q, i = np.divmod(np.flatnonzero(scores >= (bar - slack)[:, None]), n)
    s = _rounded(scores[q, i], digits)
    tied = s == bar[q]
    count = np.concatenate([[0], np.cumsum(tied)])
    earlier = count[:-1] - count[np.searchsorted(q, q)]
    keep = (s > bar[q]) | (tied & (earlier < k))
    return q[keep], i[keep], s[keep]


def _candidates(queries, items, k, floor, digits):
    """(query position, item position, score) of the items that can be among the best
    ``k`` of their query, given the scores they have to reach so far (``floor``).

    Products in single precision, whose error has a bound, tell which pairs can reach the floor, or the
    k-th best of the block; only those are scored, in double. Where a query has a crowd of them, as among copies, its block is scored in
    double at once. Items come ordered by id, so of equal scores there the first ``k`` are enough: a block full of copies yields few rows, too.
    """
    import numpy as np

    slack = 0.0 if digits is None else 0.51 * 10.0 ** -digits
    wide = max(1, min(len(items), max(k + 1, _SCORES_AT_ONCE // 256)))
    tall = max(1, _SCORES_AT_ONCE // wide)
    lengths = [np.sqrt(np.einsum("ij,ij->i", m, m)) for m in (queries, items)]
    longest = [np.nanmax(x, initial=0.0) for x in lengths]
    # of rounding both vectors and of the sum, see Higham, Accuracy and Stability of Numerical Algorithms, 3.1; numbers below single precision's range add next to nothing
    error = 1.01 * (queries.shape[1] + 3) * 2.0 ** -24 * lengths[0] * longest[1] + 1e-30
    single = max(longest) < 1e10
    if single:
        left, right = queries.astype(np.float32), items.astype(np.float32)
    found = []
    for top in range(0, len(queries), tall):
        asked, bar, off = queries[top:top + tall], floor[top:top + tall], error[top:top + tall]
        for start in range(0, len(items), wide):
            block, mine = items[start:start + wide], []
            if single:
                scores = left[top:top + tall] @ right[start:start + wide].T
                tops = _maxima(scores, k)
                width = tops.shape[1]
                reach = bar - slack - off
                fresh = np.isneginf(bar)
                if fresh.any() and width >= k:
                    best = tops if fresh.all() else tops[fresh]
                    best = best.max(axis=1) if k == 1 else np.partition(best, width - k, axis=1)[:, width - k]
                    reach[fresh] = best - 2 * (off[fresh] + slack)
                reach = np.nextafter(reach.astype(np.float32), np.float32(-np.inf))  # not above what it was in double
                q, i = np.divmod(np.flatnonzero(tops >= reach[:, None]), width)
                crowd = np.bincount(q, minlength=len(asked)) > _CROWD * k
                crowded = np.flatnonzero(crowd)
                if len(crowded):
                    q, i = q[~crowd[q]], i[~crowd[q]]
                places = np.arange(0, len(block), width)
                q, i = np.repeat(q, len(places)), (i[:, None] + places).ravel()
                there = i < len(block)
                there[there] = scores[q[there], i[there]] >= reach[q[there]]
                q, i = q[there], i[there]
                s = _rounded(np.einsum("ij,ij->i", asked[q], block[i]), digits)
                keep = s >= bar[q]
                mine.append((q[keep], i[keep], s[keep]))
            else:
                crowded = np.arange(len(asked))
            if len(crowded):
                q, i, s = _crowded(asked[crowded], block, bar[crowded], k, slack, digits)
                mine.append((crowded[q], i, s))
            found += [(q + top, i + start, s) for q, i, s in mine]
            if start + wide < len(items):
                for q, _, s in mine:
                    bar = _raised(bar, q, s, k)
    return tuple(np.concatenate(part) for part in zip(*found))


def _raised(bar, q, s, k):
    """``bar`` raised to the k-th best of the scores ``s`` where a query has as many; ``q`` is in order."""
    import numpy as np

    held, first, count = np.unique(q, return_index=True, return_counts=True)
    full = count >= k
    if not full.any():
        return bar
    order = np.lexsort((-s, q))
    bar = bar.copy()
    bar[held[full]] = np.maximum(bar[held[full]], s[order][first[full] + k - 1])
    return bar


def _cut(table, k, id_col):
    """Best ``k`` rows per query position of an Arrow table, ordered by score, then id."""
    import numpy as np
    import pyarrow.compute as pc

    order = pc.sort_indices(
        table, sort_keys=[("_q", "ascending"), ("_score", "descending"), (id_col, "ascending")]
    )
    table = table.take(order)
    q = table.column("_q").to_numpy()
    place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    return table.filter(place < k)


def _matrix(column):
    """A list column without nulls as a two-dimensional array."""
    import numpy as np
    import pyarrow.compute as pc

    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    widths = pc.unique(pc.list_value_length(column))
    if len(widths) > 1:
        raise ValueError(f"vectors of different width: {widths.to_pylist()}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def _query_groups(table, by, vector, normalize):
    """Queries per group key: their positions in ``table`` and their matrix."""
    import numpy as np

    keys = list(zip(*[table.column(c).to_pylist() for c in by])) if by else [()] * len(table)
    positions = {}
    for place, key in enumerate(keys):
        if None not in key:
            positions.setdefault(key, []).append(place)
    groups = {}
    for key, rows in positions.items():
        matrix = _matrix(table.column(vector).take(rows))
        groups[key] = (np.asarray(rows), _unit(matrix) if normalize else matrix)
    return groups


def _group_rows(batch, by):
    """Group key and row numbers for each group in an Arrow batch."""
    import numpy as np
    import pyarrow.compute as pc

    if not by:
        yield (), np.arange(batch.num_rows)
        return
    columns = [batch.column(c).dictionary_encode() for c in by]
    codes = np.stack(
        [pc.fill_null(c.indices, -1).to_numpy(zero_copy_only=False) for c in columns], axis=1
    )
    kinds, member = np.unique(codes, axis=0, return_inverse=True)
    member = member.ravel()
    for number, kind in enumerate(kinds):
        if (kind >= 0).all():
            key = tuple(c.dictionary[int(code)].as_py() for c, code in zip(columns, kind))
            yield key, np.nonzero(member == number)[0]


def _best(batches, groups, names, k, by, id_col, vector, query_id, keep, normalize, digits):
    """Hits of the queries ``groups`` among the items of ``batches``; a running best ``k`` is kept."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    best, floors = {}, {}
    for batch in batches:
        if batch.column(vector).null_count:
            batch = batch.filter(batch.column(vector).is_valid())
        if batch.num_rows == 0:
            continue
        batch = batch.take(pc.sort_indices(batch.column(id_col)))
        payload = batch.select([id_col, *keep])
        for key, rows in _group_rows(batch, by):
            if key not in groups:
                continue
            matrix = _matrix(batch.column(vector).take(pa.array(rows)))
            sound = np.isfinite(matrix).all(axis=1)
            if not sound.all():
                matrix, rows = matrix[sound], rows[sound]
            if not len(rows):
                continue
            places, query_matrix = groups[key]
            if query_matrix.shape[1] != matrix.shape[1]:
                raise ValueError(
                    f"query width {query_matrix.shape[1]}, item width {matrix.shape[1]}"
                )
            floor = floors.setdefault(key, np.full(len(places), -np.inf))
            q, i, s = _candidates(
                query_matrix, _unit(matrix) if normalize else matrix, k, floor, digits
            )
            if not len(q):
                continue
            table = pa.Table.from_batches([payload.take(pa.array(rows[i]))])
            table = table.append_column("_q", pa.array(places[q], pa.int64()))
            table = table.append_column("_score", pa.array(s, pa.float64()))
            if key in best:
                table = pa.concat_tables([best[key], table])
            table = _cut(table, k, id_col).combine_chunks()
            best[key] = table
            # the k-th score of a query with k hits is the bar for what follows
            held, first, count = np.unique(
                table.column("_q").to_numpy(), return_index=True, return_counts=True
            )
            full = count == k
            bar = table.column("_score").to_numpy()[first[full] + k - 1]
            floor[np.searchsorted(places, held[full])] = bar
    for table in best.values():
        who = names.take(table.column("_q"))
        columns = [who.column(c) for c in [*by, query_id]]
        columns += [table.column(id_col), table.column("_score")]
        columns += [table.column(c) for c in keep]
        out = pa.table(columns, names=[*by, query_id, id_col, "score", *keep])
        yield from out.combine_chunks().to_batches()


def _send_queries(items, queries_table, k, by, id_col, vector, query_id, keep, normalize,
                  digits, schema):
    """Score against queries sent to every task."""
    sent = items.sparkSession.sparkContext.broadcast((
        _query_groups(queries_table, by, vector, normalize),
        queries_table.select([*by, query_id]),
    ))

    def score(batches):
        yield from _best(batches, *sent.value, k, by, id_col, vector, query_id, keep, normalize, digits)

    used = list(dict.fromkeys([*by, id_col, vector, *keep]))
    return items.select(*used).mapInArrow(score, schema)


def _grid(items, queries, k, by, id_col, vector, query_id, keep, normalize, digits, schema, key, chunk):
    """Score chunks of queries against chunks of items of their group, a pair of chunks (a cell) in a task of its own, large ones first.

    A chunk goes to as many tasks as the other side has chunks; what a task holds is bounded by ``chunk`` rows of either.
    """
    spark = items.sparkSession
    used = list(dict.fromkeys([*by, id_col, vector, *key, *keep]))
    items = stored(items.select(*used).filter(F.col(vector).isNotNull()), "items")
    count = F.count(F.lit(1))
    if by:  # one row per group
        sizes = items.groupBy(*by).agg(count.alias("_items")).join(queries.groupBy(*by).agg(count.alias("_queries")), by).collect()
    else:
        sizes = [{"_items": items.count(), "_queries": queries.count()}]
    cores, shapes = spark.sparkContext.defaultParallelism, []
    for r in sizes:
        across = max(1, math.ceil(r["_queries"] / chunk))
        enough = math.ceil(4 * cores / (len(sizes) * across))
        down = max(1, math.ceil(r["_items"] / chunk), min(enough, math.ceil(r["_items"] / LEAST_CHUNK)))
        shapes.append((r["_items"] * r["_queries"] / (across * down), across, down, [r[c] for c in by]))
    rows, cells = [], 0
    for _, across, down, group in sorted(shapes, key=lambda s: -s[0]):
        rows.append((*group, cells, across, down))
        cells += across * down
    fields = [*[queries.schema[c] for c in by], *[T.StructField(c, T.IntegerType()) for c in ("_first", "_across", "_down")]]
    shape = F.broadcast(spark.createDataFrame(rows, T.StructType(fields)))

    def placed(df, numbers):
        each = df.join(shape, by) if by else df.crossJoin(shape)
        return each.select(*df.columns, F.explode(F.expr(numbers)).alias("_cell")).repartitionById(max(1, min(cells, 4096)), F.col("_cell")).groupBy("_cell")

    def number(side, *names):
        return f"cast(pmod(xxhash64({', '.join(f'`{c}`' for c in names)}), _{side}) AS int)"

    def score(left, right):
        import pyarrow as pa

        out = list(_best(left.combine_chunks().to_batches(max_chunksize=10_000), _query_groups(right, by, vector, normalize), right.select([*by, query_id]),
                         k, by, id_col, vector, query_id, keep, normalize, digits))
        if out:
            return pa.Table.from_batches(out)
        source = {**{c: right for c in [*by, query_id]}, **{c: left for c in [id_col, *keep]}}
        return pa.table({f: pa.array([], pa.float64() if f == "score" else source[f].schema.field(f).type) for f in schema.fieldNames()})

    # cells are numbered by row: the chunks of items down, those of queries across
    mine = f"_first + {number('down', id_col, *key)} * _across"
    left = placed(items, f"sequence({mine}, {mine} + _across - 1)")
    mine = f"_first + {number('across', query_id)}"
    right = placed(queries, f"sequence({mine}, {mine} + (_down - 1) * _across, _across)")
    return left.cogroup(right).applyInArrow(score, schema)


def _rows_at_once(queries, vector, k, max_queries, max_bytes):
    """How many queries may be sent at once; the width of the first vector tells their size."""
    first = queries.select(F.size(vector).alias("width")).first()
    width = max(1, first["width"]) if first else 1
    return max(1, min(max_queries, max_bytes // (8 * width), MAX_SENT_HITS // max(1, k)))


def top_k(items: DataFrame, queries: DataFrame, k=V.TOP_K, by=(), id_col="id",
          vector="vector", query_id="query_id", keep=(), fetch=(), normalize=True, digits=6,
          key=(), max_sent_queries=MAX_SENT_QUERIES, max_sent_bytes=MAX_SENT_BYTES) -> DataFrame:
    """The best ``k`` items per query, exactly; fewer than ``k`` where there are fewer.

    ``queries`` holds ``by`` columns, ``query_id`` and ``vector``; a query is answered
    within its own group of ``by`` values (an approach, a result type). A null group has
    no answers. ``keep`` are small item columns carried along; ``fetch`` are wide ones read
    afterwards, for the hits only. ``key`` are the columns besides ``by`` and the id that make
    an item unique, such as the document; they are carried along, too. Equal scores are
    ordered by id. Items without a vector, or with a
    coordinate that is no number, are not found (the test is made while scoring: as a
    filter it would compute the vector twice). Scores are rounded to ``digits`` before
    ranking, so the order does not depend on how the data was split.

    Queries within the limits are sent to the tasks, and no vector is shuffled. Beyond them queries and items are
    stored and dealt into chunks, and each pair of chunks is a task: vectors are shuffled as
    often as the other side has chunks, and none passes through the driver.
    """
    by, keep, fetch, key = list(by), list(keep), list(fetch), list(key)
    keep = [*[c for c in key if c not in keep], *keep]
    schema = T.StructType([
        *[queries.schema[c] for c in [*by, query_id]],
        items.schema[id_col], T.StructField("score", T.DoubleType(), True),
        *[items.schema[c] for c in keep],
    ])
    queries = queries.select(*by, query_id, vector).filter(F.col(vector).isNotNull())
    limit = _rows_at_once(queries, vector, k, max_sent_queries, max_sent_bytes)

    def asked(groups):
        wanted = items
        for c in by:  # literals, so that only the folders of these groups are read
            wanted = wanted.filter(F.col(c).isin(sorted(set(groups.column(c).to_pylist()) - {None})))
        return wanted

    how = (k, by, id_col, vector, query_id, keep, normalize, digits, schema)
    probe = queries.limit(limit + 1).toArrow()
    if probe.num_rows <= limit:
        found = _send_queries(asked(probe), probe, *how)
    else:
        width = max(1, len(probe.column(vector)[0]))
        del probe
        held = stored(queries, "queries")
        chunk = max(LEAST_CHUNK, CHUNK_BYTES // (8 * width))
        found = stored(_grid(asked(held.select(*by).distinct().toArrow()) if by else items, held, *how, key, chunk), "scored")
    order = Window.partitionBy(*by, query_id).orderBy(F.desc("score"), F.asc(id_col), *[F.asc(c) for c in key])
    hits = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if fetch:
        hits = fetched(stored(hits, "hits"), items, fetch, [*by, *key, id_col])
    return hits.select(*by, query_id, "rank", id_col, "score", *keep, *fetch)


def fetched(hits: DataFrame, items: DataFrame, columns, keys) -> DataFrame:
    """Hits with further columns of their items. ``hits`` is a table, so Spark knows its
    size and sends it out only where that is small. A null key meets a null key."""
    side = items.select(*[F.col(c).alias(f"_{c}") for c in keys], *columns)
    same = None
    for c in keys:
        one = F.col(c).eqNullSafe(F.col(f"_{c}")) if hits.schema[c].nullable else F.col(c) == F.col(f"_{c}")
        same = one if same is None else same & one
    return hits.join(side, same).drop(*[f"_{c}" for c in keys])


def agreement(hits: DataFrame, query_id="query_id", id_col="id") -> DataFrame:
    """How much the approaches have to say: results and pages per query and approach, and the best result."""
    return hits.groupBy(query_id, "approach_id").agg(
        F.count(F.lit(1)).alias("results"), F.countDistinct("page").alias("pages"),
        F.max("score").alias("best_score"),
        F.min(F.struct((-F.col("score")).alias("s"), F.col(id_col).alias("i")))["i"].alias("best_id"),
    )


def best_page(hits: DataFrame, by=("approach_id",), query_id="query_id", id_col="id",
              text="original_text", items: DataFrame = None, key=()) -> DataFrame:
    """The page to open per query: the image's if its best score is strictly higher, else
    the text's, with a snippet to mark. A side without a hit counts as -1; when neither
    side has more than that there is no page.

    Either the hits carry the ``text``, or ``items`` does: then it is read for the texts
    that come first, and for no others."""
    first = hits.filter(F.col("rank") == 1)
    if items is not None:
        first = stored(first, "first")
        is_text = F.col("type") == "text"  # said of both sides, so that a store's images are not read
        texts = fetched(first.filter(is_text), items.filter(is_text), [text], [*by, "type", *key, id_col])
        first = first.filter(F.col("type") != "text").withColumn(text, F.lit(None).cast("string")).unionByName(texts)
    first = first.withColumn("_snippet", X.first_words(F.col(text)))

    def top(kind, column):
        return F.max(F.when(F.col("type") == kind, F.col(column)))

    sides = first.groupBy(*by, query_id).agg(
        F.coalesce(top("image", "score"), F.lit(-1.0)).alias("image_score"),
        F.coalesce(top("text", "score"), F.lit(-1.0)).alias("text_score"),
        top("image", "page").alias("image_page"), top("text", "page").alias("text_page"),
        top("image", id_col).alias("image_id"), top("text", id_col).alias("text_id"),
        top("text", "_snippet").alias("text_snippet"),
    )
    image = F.col("image_score") > F.col("text_score")
    some_text = F.col("text_score") != -1

    def choose(from_image, from_text):
        return F.when(image, from_image).when(some_text, from_text)

    return sides.select(
        *by, query_id,
        choose(F.lit("image"), F.lit("text")).alias("type"),
        choose(F.col("image_id"), F.col("text_id")).alias(id_col),
        choose(F.col("image_page"), F.col("text_page")).alias("page"),
        F.when(~image & some_text, F.col("text_snippet")).alias("snippet"),
    ).filter(F.col("type").isNotNull())
