"""Repeated passages by recompression of word sequences.

Rounds of naming: equal neighbours become a run symbol, then a symbol of the left half of
the alphabet and a following one of the right half become a pair symbol. Symbols keep to
four words, so whether a border between two symbols exists depends on four words to each
side: equal passages have equal interior symbols. A name is a function of what it stands
for, the same in every task, so that naming moves no text.

Spark then names upwards and keeps what is shared: borders by the eight words around them,
their contexts (all windows that a border stands for), and, where contexts differ, the
windows themselves.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import spans
from .arrow import Texts, over_texts
from .shared import released, scratch, stored
from .words import BASE, INVERSE, U, Words, mix, powers, run_names

REACH = 4  # words to each side that settle a border


def borders(words):
    """True for the words before which a symbol border stands after a run and a pair round."""
    names, row = words.names, words.row
    n = len(names)
    if not n:
        return np.zeros(0, bool)
    start = np.zeros(n + 2, bool)
    start[words.first[:-1][words.counts > 0]] = True
    start[n:] = True
    same = np.zeros(n + 2, bool)  # equal to the word before, in one text
    same[1:n] = (names[1:] == names[:-1]) & (row[1:] == row[:-1])
    # run round: runs of exactly two words, so that no symbol outgrows its bound
    second = same[:n].copy()
    second[1:] &= ~same[:n - 1]
    second &= ~same[1:n + 1]
    border = ~second
    at = np.flatnonzero(border)
    size = np.diff(np.append(at, n))
    symbols = mix(names[at] * U(4) + size.astype(U))
    # pair round: left symbol, right symbol
    right = (symbols >> U(40)) & U(1) == 1
    joins = np.zeros(len(at), bool)
    joins[1:] = right[1:] & ~right[:-1] & ~start[at[1:]]
    border[at[joins]] = False
    return border


def _span_names(names, starts, ends):
    """Names of word spans [start, end)."""
    n = len(names)
    total = np.zeros(n + 1, U)
    np.cumsum(names * powers(BASE, n)[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * powers(INVERSE, n)[starts] + (ends - starts).astype(U))


def _anchored(rows, width):
    """(block, context, i, h, lo, hi): a border, its context, and the windows it stands for."""
    def work(piece):
        words = Words(Texts(piece.column(2)))
        names = words.names
        if len(names) < width:
            return None
        ends = words.first[words.row + 1]
        around = np.zeros(len(names), U)
        four = run_names(names, 4)
        around[2:2 + len(four)] = four[:len(names) - 2]
        at, lo, hi = spans.anchors(around, borders(words), REACH, width - REACH - 1, ends, width)
        if not len(at):
            return None
        base = words.first[words.row[at]]
        block = run_names(names, 2 * REACH)[at - REACH]
        context = mix(_span_names(names, lo, hi + width) + (at - lo).astype(U) * BASE)
        take = pa.array(words.row[at])
        return pa.RecordBatch.from_arrays(
            [pa.array(block.view(np.int64)), pa.array(context.view(np.int64)), piece.column(0).take(take), piece.column(1).take(take),
             pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32))],
            names=["block", "context", "i", "h", "lo", "hi"])

    return over_texts(rows.select("i", "h", "text"), 2, work, "block long, context long, i long, h long, lo int, hi int")


def _windows(rows, width):
    """(block, name, i, h, a) of every window of the given borders; ``open``: their list."""
    def work(piece):
        texts = Texts(pa.array([spans.unpacked(x) for x in piece.column(2).to_pylist()], pa.binary()))
        words = Words(texts)
        lists = piece.column(3)
        row = np.repeat(np.arange(piece.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        flat = lists.flatten()
        lo, hi = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "hi"))
        count = hi - lo + 1
        each = np.repeat(np.arange(len(lo)), count)
        at = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + lo[each]
        place = words.first[row[each]] + at
        name = _span_names(words.names, place, place + width)
        take = pa.array(row[each])
        return pa.RecordBatch.from_arrays(
            [flat.field("block").take(pa.array(each)), pa.array(name.view(np.int64)), piece.column(0).take(take), piece.column(1).take(take), pa.array(at.astype(np.int32))],
            names=["block", "name", "i", "h", "a"])

    return over_texts(rows.select("i", "h", "text", "open"), 2, work, "block long, name long, i long, h long, a int", limit=1 << 20)


def repeated_spans(docs, id_col="doc_id", text_col="text", width=35):
    """(i, h, a, b): word spans covered by windows whose words also start elsewhere.

    A context that occurs twice settles all its windows. Windows are compared one by one
    only where a block has several contexts, one of them alone; then one text per context
    takes part.
    """
    rows = spans.keyed(docs, id_col, text_col)
    spark = docs.sparkSession
    all_path, all_borders = scratch(_anchored(rows, width), "borders")
    # tables of their own: Spark splits a hot key of a join only where both sides come as they are
    blocks = stored(all_borders.groupBy("block").agg(F.count("*").alias("n")).where("n > 1").select("block"), "blocks")
    shared = stored(all_borders.join(blocks, "block", "left_semi"), "shared")
    released(spark, all_path)
    contexts = stored(shared.groupBy("block", "context").agg(F.count("*").alias("n"), F.min(F.struct("i", "h", "lo", "hi")).alias("one")), "contexts")
    settled = shared.join(contexts.where("n > 1").select("block", "context"), ["block", "context"], "left_semi")
    open_blocks = contexts.groupBy("block").agg(F.min("n").alias("least"), F.count("*").alias("contexts")).where("least = 1 AND contexts > 1")
    compared = contexts.join(stored(open_blocks.select("block"), "open"), "block", "left_semi")
    wanted = compared.groupBy(F.col("one.i").alias("i"), F.col("one.h").alias("h")).agg(
        F.collect_set(F.struct("block", F.col("one.lo").alias("lo"), F.col("one.hi").alias("hi"))).alias("open"))
    # a text that is there twice is read twice; its windows do occur twice
    windows = stored(_windows(spans.packed(rows).join(wanted, ["i", "h"]), width), "windows")
    twice = stored(windows.groupBy("block", "name").agg(F.count("*").alias("n")).where("n > 1").select("block", "name"), "twice")
    found = windows.join(twice, ["block", "name"], "left_semi")
    return settled.select("i", "h", F.col("lo").alias("a"), (F.col("hi") + width).alias("b")).union(
        found.select("i", "h", "a", (F.col("a") + width).alias("b")))


def trimmed(docs, id_col="doc_id", text_col="text", width=35, with_text=False):
    """(id, n_words, n_removed, n_spans, kept_sha256[, kept]) of each row.

    Words inside any repeated window go; the others are joined by one space. Null, empty
    and short texts lose nothing. Repeated rows are copies of each other and lose every
    word that a window covers, as do rows with a null id. An empty table gives an
    empty one. Other columns are not read.
    """
    found = stored(spans.by_document(repeated_spans(docs, id_col, text_col, width)), "spans")
    rows = spans.packed(spans.keyed(docs, id_col, text_col)).join(found, ["i", "h"], "left").select("id", "text", "spans")
    kind = docs.schema[id_col].dataType.simpleString()

    def work(piece):
        texts = Texts(pa.array([spans.unpacked(x) for x in piece.column(1).to_pylist()], pa.binary()))
        words = Words(texts)
        gone = np.zeros(len(words.names), bool)
        n_spans = np.zeros(texts.n, np.int64)
        for k, cell in enumerate(piece.column(2)):
            a, b = spans.union_of(*spans.span_arrays(cell.values))
            n_spans[k] = len(a)
            for x, y in zip((a + words.first[k]).tolist(), (b + words.first[k]).tolist()):
                gone[x:y] = True
        kept = _joined(texts.data, words.starts[~gone], words.ends[~gone])
        sizes = np.bincount(words.row, ~gone * (words.ends - words.starts + 1), texts.n).astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        out = [kept[a:max(a, b - 1)] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        columns = [piece.column(0), pa.array(words.counts.astype(np.int64)), pa.array(np.bincount(words.row, gone, texts.n).astype(np.int64)),
                   pa.array(n_spans), pa.array([spans.sha(x) for x in out], pa.string())]
        names = ["id", "n_words", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            columns.append(pa.array([x.decode("utf-8") for x in out], pa.string()))
            names.append("kept")
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {kind}, n_words long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    return over_texts(rows, 1, work, schema, limit=1 << 20).withColumnRenamed("id", id_col)


def _joined(data, starts, ends):
    """The byte spans one after the other, a space after each."""
    size = ends - starts + 1
    to = np.cumsum(size)
    source = np.arange(int(to[-1]) if len(to) else 0) + np.repeat(starts - (to - size), size)
    out = np.append(data, np.uint8(32))[np.minimum(source, len(data))]
    out[to - 1] = 32
    return out.tobytes()
