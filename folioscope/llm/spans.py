"""What the two removers of repeated passages share: consistent anchors, keys, cut texts."""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F, types as T

from .words import U, mix

PLACE = U(0xFFFFFFFF)


def sliding_min(keys, width):
    """Minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    rest = width - have
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def anchors(names, allowed, first, last, ends, width):
    """Anchor of every window, and the windows of every anchor.

    A window of ``width`` places beginning at s has as its anchor the allowed place among
    s + first .. s + last with the smallest name, the leftmost of equals. Names depend on
    what stands around a place inside the window, so equal windows have their anchors at
    equal distances. ``ends`` gives for each place where its text ends. Returns anchor
    place, first and last window; an anchor's windows are neighbours.
    """
    n = len(names)
    if n < width:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    keys = (mix(names) & ~PLACE) | np.arange(n, dtype=U)
    if allowed is not None:
        keys = np.where(allowed, keys, ~U(0) & ~PLACE | np.arange(n, dtype=U))
    low = sliding_min(keys, last - first + 1)[first:first + n - width + 1]
    starts = np.flatnonzero(np.arange(n - width + 1) + width <= ends[:n - width + 1])
    place = (low[starts] & PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    lasts = np.concatenate([new[1:] - 1, [len(place) - 1]]) if len(place) else new
    return place[new], starts[new], starts[lasts]


def keyed(docs, id_col, text_col):
    """(i, h, id, text): ``i`` and ``h`` are never null and differ where id or text differ. Ids that are no whole numbers count by their hash."""
    id_, text = docs[id_col], docs[text_col].cast("string")
    number = id_.cast("long") if isinstance(docs.schema[id_col].dataType, T.IntegralType) else F.xxhash64(id_)
    return docs.select(F.coalesce(number, F.lit(0).cast("long")).alias("i"),
                       F.xxhash64(id_.isNull(), text).alias("h"), id_.alias("id"), text.alias("text"))


def packed(rows):
    """``text`` as compressed bytes, for texts that go through a shuffle. Null becomes empty."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            raw = [pack((t or "").encode("utf-8")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("i", "h", "id")], pa.array(raw, pa.binary())],
                                             names=["i", "h", "id", "text"])

    return rows.mapInArrow(run, f"i long, h long, id {kind}, text binary")


def unpacked(raw):
    return zstandard.ZstdDecompressor().decompress(raw)


def union_of(starts, ends):
    """Maximal runs covered by [start, end) intervals."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]])) if len(starts) else np.zeros(0, np.int64)
    return starts[new], ends[np.concatenate([new[1:] - 1, [len(ends) - 1]])] if len(starts) else ends


def without(data, starts, ends):
    """Bytes outside the maximal runs [start, end)."""
    keep, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        keep.append(data[at:a])
        at = b
    keep.append(data[at:])
    return b"".join(keep)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def by_document(intervals):
    """(i, h, spans) of the intervals (i, h, a, b); a text has at most as many as anchors."""
    return intervals.groupBy("i", "h").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def span_arrays(cell):
    """Starts and ends of an Arrow list<struct<a, b>> value."""
    if cell is None or not len(cell):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (cell.field("a").to_numpy(zero_copy_only=False).astype(np.int64),
            cell.field("b").to_numpy(zero_copy_only=False).astype(np.int64))
