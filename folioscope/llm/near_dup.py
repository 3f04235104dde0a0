"""Near-duplicate documents: SuperMinHash signatures, banding, verification, grouping.

Documents with equal shingle sets are one class from the start, so copies meet no further
step. Class representatives get a SuperMinHash signature; equal bands put them into
buckets. In a bucket a pivot is compared with the rest, on their full sets, which joins what is
much alike. Buckets that hold several groups even then are cut into blocks of texts. Blocks meet in tasks
of their own, where full sets are compared exactly, and a union-find leaves only links that join
groups: no pair of members is ever a row.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import components
from .arrow import SMALL_BYTES, Texts, over_texts, pieces
from .shared import stored
from .words import U, Words, mix, per_row

SLOTS = 128
BAND = 4  # slots per band; a pair at 0.8 shares none of the 32 bands with probability 5e-8
ESTIMATE_SLACK = 0.18  # a pair whose signatures agree this much less than asked, five deviations, is not verified
STEP = U(0x9E3779B97F4A7C15)
FAMILY, FAMILY_SHINGLES = 512, 200_000  # texts, and their shingles, of a block
PURE = 64  # members of one group in a family that get blocks of their own, which need not meet each other
SPARSE, WIDE = 8, 4096  # texts of a shingle up to which its pairs are counted one by one; shingles of a matrix product


def shingles(texts, width, lower=True):
    """(row, name) of the distinct shingles. Fewer words than ``width``: all of them as one."""
    words = Words(texts, lower)
    at, names = words.windows(width)
    rows = words.row[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        more = []
        for n in range(1, width):
            these = short[words.counts[short] == n]
            if len(these):
                first = words.first[these]
                named = np.zeros(len(these), U)
                for j in range(n):
                    named = named * STEP + words.names[first + j]
                more.append((these, mix(named + U(n))))
        rows = np.concatenate([rows, *[r for r, _ in more]])
        names = np.concatenate([names, *[x for _, x in more]])
    keys = per_row(names, rows)
    _, keep = np.unique(keys, return_index=True)
    return rows[keep], names[keep]


def _sets(batch, width, lower):
    """``shingles`` of the column ``text`` of a batch, piece by piece."""
    found, before = [], 0
    for piece in pieces(batch, "text", SMALL_BYTES):
        rows, names = shingles(Texts(piece.column("text")), width, lower)
        found.append((rows + before, names))
        before += piece.num_rows
    return tuple(np.concatenate(x) for x in zip(*found))


def _draw(names, level):
    """For each element its random number in [0, 1) and a second draw, at one level."""
    x = mix(names + STEP * U(2 * level + 1))
    y = mix(names + STEP * U(2 * level + 2))
    return (x >> U(11)).astype(np.float64) * 2.0 ** -53, y


def signatures(rows, names, n_rows, slots=SLOTS):
    """SuperMinHash values of the sets, one line per row.

    Element e puts r_j + j into the slot at place j of its own random permutation, and a
    slot keeps its smallest value. Levels j are taken for all elements at once; a row stops
    at the level after which no later value (all are at least j + 1) could change it.
    """
    values = np.full(n_rows * slots, np.inf)
    r, y = _draw(names, 0)
    pick = (y % U(slots)).astype(np.int64)
    np.minimum.at(values, rows * slots + pick, r)
    table = values.reshape(n_rows, slots)
    has = np.zeros(n_rows, bool)
    has[rows] = True
    todo = has & (table.max(1) >= 1)
    active = todo[rows]
    rows, names, pick = rows[active], names[active], pick[active]
    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(rows), 1))
    level = 0
    while len(rows):
        each = np.arange(len(rows))
        if level:
            r, y = _draw(names, level)
            pick = level + (y % U(slots - level)).astype(np.int64)
        here = order[each, pick]
        order[each, pick] = order[:, level]
        if level:
            np.minimum.at(values, rows * slots + here, r + level)
        level += 1
        if level == slots:
            break
        todo = has & (table.max(1) >= level)
        active = todo[rows]
        if level > 1 and not active.all():
            rows, names, order = rows[active], names[active], order[active]
    return table


def nodes(docs, id_col, text_col):
    """(id, text): the node of a row is its id and its text, so rows that share an id are compared by their own texts.

    Nodes are ordered by id, null ids last.
    """
    id_, text = docs[id_col], docs[text_col].cast("string")
    return docs.select(F.struct(id_.isNull().alias("none"), id_.alias("id"), F.xxhash64(text).alias("h")).alias("id"), text.alias("text"))


def signed(docs, id_col, text_col, width, lower=True):
    """(id, n_shingles, set_a, set_b, sig, bands) of each row; ``id`` is the row's node."""
    rows = nodes(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def work(piece):
        texts = Texts(piece.column(1))
        rows, names = shingles(texts, width, lower)
        n = np.bincount(rows, minlength=texts.n)
        by_row = np.argsort(rows, kind="stable")
        edges = np.concatenate([[0], np.cumsum(n)])
        sums = []
        for salt in (1, 2):  # order-free fingerprints of the whole set
            total = np.concatenate([[U(0)], np.cumsum(mix(names[by_row] + U(salt)), dtype=U)])
            sums.append(mix(total[edges[1:]] - total[edges[:-1]]).view(np.int64))
        table = signatures(rows, names, texts.n).view(U)
        bands = np.empty((texts.n, SLOTS // BAND), U)
        for b in range(SLOTS // BAND):
            name = np.full(texts.n, U(b + 1))
            for j in range(b * BAND, (b + 1) * BAND):
                name = mix(name * STEP + table[:, j])
            bands[:, b] = name
        short = (mix(table) >> U(48)).astype(np.uint16)
        return pa.RecordBatch.from_arrays(
            [piece.column(0), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]),
             pa.array([x.tobytes() for x in short], pa.binary()),
             pa.array(list(bands.view(np.int64)), pa.list_(pa.int64()))],
            names=["id", "n_shingles", "set_a", "set_b", "sig", "bands"])

    return over_texts(rows, 1, work, f"id {kind}, n_shingles long, set_a long, set_b long, sig binary, bands array<long>", limit=SMALL_BYTES)


def _estimated(pairs, signs, least):
    """Pairs whose signatures agree in at least a share ``least`` of the slots."""
    a = signs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"))
    b = signs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))
    # candidates grow with the documents, so neither side is ever sent out whole
    both = pairs.hint("merge").join(a, "a").hint("merge").join(b, "b")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches):
        for rows in batches:
            left, right = rows.column("sig_a").to_pylist(), rows.column("sig_b").to_pylist()
            x = np.frombuffer(b"".join(left), np.uint16).reshape(len(left), SLOTS)
            y = np.frombuffer(b"".join(right), np.uint16).reshape(len(right), SLOTS)
            keep = pa.array((x == y).mean(1) >= least) if len(left) else pa.array([], pa.bool_())
            yield rows.select(["a", "b"]).filter(keep)

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, f"a {kind}, b {kind}")


def _verified(pairs, texts, width, lower, percent):
    """Pairs with 100 * intersection >= percent * union of their full sets."""
    kind = pairs.schema["a"].dataType.simpleString()
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.hint("merge").join(a, "a").hint("merge").join(b, "b").select("text_a", "text_b", "a", "b")

    def work(piece):
        n = piece.num_rows
        rows_a, names_a = shingles(Texts(piece.column(0)), width, lower)
        rows_b, names_b = shingles(Texts(piece.column(1)), width, lower)
        common = np.isin(per_row(names_a, rows_a), per_row(names_b, rows_b))
        inter = np.bincount(rows_a, common, n)
        union = np.bincount(rows_a, minlength=n) + np.bincount(rows_b, minlength=n) - inter
        keep = (100 * inter >= percent * union) & (union > 0)
        return piece.select(["a", "b"]).filter(pa.array(keep))

    return over_texts(both, 0, work, f"a {kind}, b {kind}", limit=SMALL_BYTES)


def _compared(pairs, n, signs, docs, id_col, text_col, width, lower, percent):
    """Links among ``n`` pairs at most: estimated by signature, then verified on full sets."""
    pairs = (pairs.where("id <> pivot")
             .select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct())
    pairs = stored(pairs, "pairs", n)
    near = stored(_estimated(pairs, signs, percent / 100 - ESTIMATE_SLACK), "near", n)
    wanted = near.select(F.col("a").alias("id")).union(near.select("b")).distinct()
    texts = nodes(docs, id_col, text_col).join(wanted.hint("merge"), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    texts = stored(texts, "texts")
    return stored(_verified(near, texts, width, lower, percent), "links")


def intersections(rows, names, n, split):
    """Sizes of the intersections of sets ``rows``/``names``: those before ``split`` with those from it on, or all with all at ``split`` n.

    Shingles of few texts add their pairs one by one, the others by products of 0/1 matrices.
    """
    _, code, seen = np.unique(names, return_inverse=True, return_counts=True)
    order = np.argsort(code, kind="stable")
    code, rows = code[order], rows[order]
    first = np.concatenate([[0], np.cumsum(seen)])[:-1]
    total = np.zeros((n, n), np.float32)
    for k in range(2, SPARSE + 1):
        members = rows[first[seen == k][:, None] + np.arange(k)]
        for i in range(k):
            for j in range(i + 1, k):
                np.add.at(total, (members[:, i], members[:, j]), 1)
    total += total.T
    dense = np.flatnonzero(seen > SPARSE)
    for at in range(0, len(dense), WIDE):
        some = dense[at:at + WIDE]
        cells = np.concatenate([np.arange(first[c], first[c] + seen[c]) for c in some])
        matrix = np.zeros((n, len(some)), np.float32)
        matrix[rows[cells], np.searchsorted(some, code[cells])] = 1
        if split < n:
            total[:split, split:] += matrix[:split] @ matrix[split:].T
        else:
            total += matrix @ matrix.T
    return (total[:split, split:] if split < n else total).astype(np.int64)


def _spanning(pairs):
    """Of pairs of numbers those that join what earlier ones have not joined: a union-find."""
    root, keep = {}, []

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, (a, b) in enumerate(pairs):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(k)
    return keep


def _joined(meetings, kind, width, lower, percent):
    """Links between groups, from rows (u, v, block, members) of the blocks u and v of a meeting; members are (id, group, text)."""
    def meet(key, rows):
        rows = rows.take(pa.array(np.argsort(rows.column("block").to_numpy() != key[0].as_py(), kind="stable")))
        packed = rows.column("members").combine_chunks()
        split = len(packed[0])
        table = pa.RecordBatch.from_struct_array(packed.flatten())
        n = table.num_rows
        rows, names = _sets(table, width, lower)
        size = np.bincount(rows, minlength=n)
        inter = intersections(rows, names, n, split)
        codes = {}
        group = np.array([codes.setdefault(tuple(g.values()), len(codes)) for g in table.column("group").to_pylist()])
        union = size[:split, None] + (size[None, split:] if split < n else size[None, :]) - inter
        x, y = np.nonzero((inter > 0) & (100 * inter >= percent * union))
        y = y + split if split < n else y
        apart = group[x] != group[y]
        x, y = x[apart], y[apart]
        _, one = np.unique(np.minimum(group[x], group[y]).astype(np.int64) * n + np.maximum(group[x], group[y]), return_index=True)
        one = one[_spanning(list(zip(group[x[one]].tolist(), group[y[one]].tolist())))] if len(one) else one
        ids = table.column("id")
        return pa.table({"a": ids.take(pa.array(x[one])), "b": ids.take(pa.array(y[one]))})

    return meetings.groupBy("u", "v").applyInArrow(meet, f"a {kind}, b {kind}")


def _crowd(members, n, labels):
    """(bucket, id, group, n): the members, ``n`` in all, of buckets that hold several groups."""
    held = stored(members.join(labels, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("group")), "held", n)
    crowded = stored(held.groupBy("bucket").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count("*").alias("n"))
                     .where("lo <> hi").select("bucket", "n"), "crowded", n)
    return stored(held.join(crowded, "bucket"), "crowd", n)


def _blocks(crowd, signs, pure):
    """(id, group, block): a member's family is its largest crowded bucket, and families are cut into blocks.

    ``pure``: a group with many members in a family has blocks of its own.
    """
    n = crowd.count()
    family = stored(crowd.groupBy("id", "group").agg(F.max(F.struct("n", "bucket")).alias("m"))
                    .join(signs.select("id", "n_shingles"), "id").select("id", "group", "n_shingles", F.col("m.bucket").alias("family")), "family", n)
    if pure:
        large = stored(family.groupBy("family", "group").agg(F.count("*").alias("n")).where(F.col("n") >= PURE)
                       .select("family", "group", F.lit(True).alias("pure")), "large", n)
        family = family.join(large, ["family", "group"], "left").withColumn("lot", F.xxhash64("family", F.when(F.col("pure"), F.col("group"))))
    else:
        family = family.withColumn("lot", F.xxhash64("family"))
    family = stored(family, "lots", n)
    sizes = stored(family.groupBy("lot").agg(F.ceil(F.greatest(F.count("*") / FAMILY, F.sum("n_shingles") / FAMILY_SHINGLES)).alias("n")), "sizes", n)
    return stored(family.join(sizes, "lot").select("id", "group", F.xxhash64("lot", F.pmod(F.xxhash64("id"), "n")).alias("block")), "blocks", n)


def _met(blocks, pairs, n, signs, docs, id_col, text_col, width, lower, percent):
    """Links of the meetings ``pairs`` (u, v) of blocks, ``n`` at most if that is known."""
    pairs = stored(pairs, "meetings", n)
    each = stored(pairs.select("u", "v", F.explode(F.array_distinct(F.array("u", "v"))).alias("block")), "each")
    wanted = stored(blocks.join(each.select("block").distinct(), "block", "left_semi"), "wanted")
    told = (nodes(docs, id_col, text_col).join(wanted.hint("merge"), "id").groupBy("id")
            .agg(F.first("group").alias("group"), F.first("block").alias("block"), F.min("text").alias("text")))
    kind = signs.schema["id"].dataType.simpleString()
    # a block is one row, however many meetings it has
    packed = stored(told.groupBy("block").agg(F.collect_list(F.struct("id", "group", "text")).alias("members")), "packed")
    return stored(_joined(each.join(packed.hint("merge"), "block"), kind, width, lower, percent), "links")


def _inside(members, n, labels, signs, docs, *how):
    """Links inside blocks: every member meets those of one block, whichever their groups, which joins most of a family."""
    blocks = _blocks(_crowd(members, n, labels), signs, pure=False)
    several = blocks.groupBy("block").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi")
    return _met(blocks, several.select(F.col("block").alias("u"), F.col("block").alias("v")), n, signs, docs, *how)


def _rest(members, n, labels, signs, docs, *how):
    """Links between groups that still share a bucket: two blocks meet if they share one and hold more than one group together."""
    crowd = _crowd(members, n, labels)
    blocks = _blocks(crowd, signs, pure=True)
    present = stored(crowd.select("bucket", "id").join(blocks, "id").groupBy("bucket", "block").agg(F.min("group").alias("lo"), F.max("group").alias("hi")), "present", n)
    left, right = (present.select("bucket", *[F.col(c).alias(f"{c}_{side}") for c in ("block", "lo", "hi")]) for side in "uv")
    several = F.least("lo_u", "lo_v") != F.greatest("hi_u", "hi_v")
    pairs = left.join(right, "bucket").where((F.col("block_u") <= F.col("block_v")) & several).select(F.col("block_u").alias("u"), F.col("block_v").alias("v")).distinct()
    return _met(blocks, pairs, None, signs, docs, *how)


def _labels(members, signs, docs, *how):
    """(id, component) of the representatives that verified links connect.

    First a bucket's members are compared with one pivot each, drawn at random. A similar pair shares 13 of the
    32 buckets on average, each with a pivot of its own, so most of a large group joins here, by
    comparisons that grow with the members. What these leave, members of different groups in one bucket, is compared in blocks:
    first each block by itself, then blocks with each other as far as groups are still apart.
    """
    n = members.count()
    draw = F.xxhash64("id", "bucket")
    pivots = members.groupBy("bucket").agg(F.min(F.struct(draw.alias("draw"), F.col("id"))).alias("p"))
    pairs = members.join(stored(pivots.select("bucket", F.col("p.id").alias("pivot")), "pivots", n), "bucket")
    labels = components.of(_compared(pairs, n, signs, docs, *how))
    for links in (_inside, _rest):
        # the groups so far stand for the links behind them
        so_far = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
        labels = components.of(links(members, n, labels, signs, docs, *how).union(so_far))
    return labels


def _grouped(docs, id_col, text_col, width, percent, lower):
    """(id, n_shingles, component): the node of each row and the smallest node reachable from it."""
    every = stored(signed(docs, id_col, text_col, width, lower), "signed")
    real = every.where("n_shingles > 0")
    classes = stored(
        real.groupBy("set_a", "set_b", "n_shingles")
        .agg(F.min(F.struct("id", "sig", "bands")).alias("rep"))
        .select("set_a", "set_b", "n_shingles", F.col("rep.id").alias("id"), F.col("rep.sig").alias("sig"), F.col("rep.bands").alias("bands")),
        "classes")
    n = classes.count()
    banded = classes.select("id", F.explode("bands").alias("bucket"))
    # tables of their own: Spark splits a hot key of a join only where both sides come as they are
    shared = stored(banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "shared", n * SLOTS // BAND)
    members = stored(banded.join(shared, "bucket", "left_semi"), "members", n * SLOTS // BAND)
    labels = _labels(members, classes, docs, id_col, text_col, width, lower, percent)
    of_class = stored(classes.select("set_a", "set_b", "n_shingles", F.col("id").alias("rep")).join(
        labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("component")), "of_class", n)
    found = every.select("id", "n_shingles", "set_a", "set_b").join(of_class, ["set_a", "set_b", "n_shingles"], "left")
    return found.select("id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component")).alias("component"))


def grouped(docs, id_col="doc_id", text_col="text", width=4, percent=80, lower=True):
    """(id, n_shingles, component_id, kept) of each row.

    Documents are linked where 100 * intersection >= percent * union of their sets of distinct
    ``width``-word shingles of the lower-cased (A-Z) text; fewer words make one shingle.
    ``component_id`` is the smallest id reachable by links, ``kept`` says that it is the own.
    Null, empty and blank texts have no shingles and stand alone. Each row is judged by its own text, also
    where rows repeat an id. A row without an id links like others; its component is null only where nobody in it has an
    id, and one text of such a component is kept. Ids may be of any type that can be ordered. Texts count whole, whatever their
    length. An empty table gives an empty one. Other columns are not read.
    """
    found = _grouped(docs, id_col, text_col, width, percent, lower)
    kept = F.when(F.col("component.id").isNull(), F.col("id") == F.col("component")).otherwise(F.coalesce(F.col("id.id") == F.col("component.id"), F.lit(False)))
    return found.select(F.col("id.id").alias(id_col), "n_shingles", F.col("component.id").alias("component_id"), kept.alias("kept"))


def representatives(docs, id_col="doc_id", text_col="text", width=5, percent=80):
    """The rows of ``docs`` that stay: one row of each group, all columns as they were.

    The row with the smallest id stays; of rows with this id and its text, one. Texts without words all stay, but of rows with
    one id only one. Nothing else is looked at to tell rows apart.
    """
    found = stored(_grouped(docs, id_col, text_col, width, percent, True), "grouped")
    n = found.count()
    name = [f"__node{k}" for k in range(len(docs.columns) + 2) if f"__node{k}" not in docs.columns][0]
    rows = docs.withColumn(name, F.struct(docs[id_col].isNull().alias("none"), docs[id_col].alias("id"), F.xxhash64(docs[text_col].cast("string")).alias("h")))
    # one row per node; a null id without words is nobody's copy
    several = found.where((F.col("id") == F.col("component")) & ~((F.col("n_shingles") == 0) & F.col("id.none"))).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    several = stored(several.select(F.col("id").alias("__several")), "several", n)
    gone = found.where("id <> component").select(F.col("id").alias("__gone"))
    gone = stored(gone.union(several).distinct(), "gone", n)
    once = rows.join(gone, F.col(name) == F.col("__gone"), "left_anti")
    packed = rows.join(several, F.col(name) == F.col("__several"), "left_semi").groupBy(name).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
    return once.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(packed.select("row.*"))
