"""Byte-level BPE: encode texts to token ids and back.

Texts are cut into pre-tokens in bulk (``pretokens``). Each different pre-token is looked up in two tiers. A
minimal perfect hash over the vocabulary resolves one that is itself a token. One that is not goes through the merges: its
bytes form a linked list, a heap holds the mergeable neighbours by rank. The ids of pre-tokens seen before in
the same worker are kept in arrays of bounded size.
"""

import base64
import heapq
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import functions as F, types as T

from . import pretokens
from .arrow import over_texts

PIECE_BYTES = 1 << 20  # text cut at once
AT_ONCE = 1 << 20  # ids decoded at once


def read_ranks(path):
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings: hash, displace, and compare the key found.

    Keys go to buckets; large buckets first, each looks for the smallest displacement that
    sends its keys to free places. There are as many places as keys. All keys are one byte string, the rest are arrays of numbers.
    """

    def __init__(self, keys, values):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        shift, at = np.zeros(self.buckets, np.uint32), np.full(n, -1, np.int64)
        members = [[] for _ in range(self.buckets)]
        for k, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            members[h % self.buckets].append((h, k))
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if not members[b]:
                break
            hashes, d, step = np.array([h for h, _ in members[b]], np.uint64), 0, 64
            while True:
                places = self._places(hashes, np.arange(d, d + step, dtype=np.uint64))
                apart = np.sort(places, axis=0)
                fits = np.flatnonzero((at[places] < 0).all(0) & (apart[1:] != apart[:-1]).all(0))
                if len(fits):
                    break
                d, step = d + step, min(2 * step, 1 << 14)
            shift[b] = d + fits[0]
            at[places[:, fits[0]]] = [k for _, k in members[b]]
        ordered = [keys[k] for k in at]
        self.shift, self.values = shift, np.array([values[k] for k in at], np.int32)
        self.blob = b"".join(ordered)
        self.edges = np.concatenate([[0], np.cumsum([len(k) for k in ordered])]).astype(np.int64)

    def _places(self, hashes, shifts):
        """``place`` for all hashes under all displacements."""
        x = hashes[:, None] ^ (shifts * np.uint64(0x9E3779B97F4A7C15))[None, :]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(self.n)).astype(np.int64)

    def place(self, h, d):
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 32)) % self.n

    def get(self, key):
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        p = self.place(h, int(self.shift[h % self.buckets]))
        return int(self.values[p]) if self.blob[self.edges[p]:self.edges[p + 1]] == key else None

    def items(self):
        edges = self.edges.tolist()
        return ((self.blob[a:b], v) for a, b, v in zip(edges[:-1], edges[1:], self.values.tolist()))


def merge(piece, ranks):
    """Token ids of a byte string by its merges, the lowest rank first, leftmost of equals.

    ``end[i]`` is where the part that starts at i ends, ``prev[i]`` where the part before it
    starts. A heap entry is rank and place in one number; one whose part has changed since
    no longer has that rank and is passed over.
    """
    n = len(piece)
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    bits = n.bit_length()
    low = (1 << bits) - 1
    heap = [(r << bits) | i for i in range(n - 1) if (r := get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        entry = pop(heap)
        i = entry & low
        j = end[i]
        if j <= 0 or j >= n:
            continue
        k = end[j]
        if get(piece[i:k]) != entry >> bits:
            continue
        end[i], end[j] = k, 0
        if k < n:
            prev[k] = i
            if (r := get(piece[i:end[k]])) is not None:
                push(heap, (r << bits) | i)
        if (p := prev[i]) >= 0 and (r := get(piece[p:k])) is not None:
            push(heap, (r << bits) | p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return tuple(out)


class Codec:
    """Vocabulary of a rank file and the pattern that cuts texts before the merges."""

    def __init__(self, ranks, pattern):
        self._set(PerfectHash(list(ranks), list(ranks.values())), pattern, pretokens.classes())

    def _set(self, whole, pattern, table):
        self.whole, self.pattern, self.table = whole, regex.compile(pattern), table
        # where the bytes of each id are
        top = int(whole.values.max()) + 1 if whole.n else 0
        self.start, self.size = np.zeros(top, np.int64), np.zeros(top, np.int64)
        self.start[whole.values], self.size[whole.values] = whole.edges[:-1], np.diff(whole.edges)
        self.key = zlib.crc32(whole.blob + whole.values.tobytes() + pattern.encode())
        self.ranks, self.sent = None, None
        bulk = pattern == public_tokenizers.PATTERN
        self.memory = pretokens.Memory(self._pieces, table) if bulk else None

    def __reduce__(self):
        return _rebuilt, (self.whole, self.pattern.pattern, self.table)

    def _pieces(self, pieces):
        """Ids of each pre-token."""
        if self.ranks is None:
            self.ranks = dict(self.whole.items())
        get, out = self.whole.get, []
        for piece in pieces:
            raw = piece.encode("utf-8")
            whole = get(raw)
            out.append((whole,) if whole is not None else merge(raw, self.ranks))
        return out

    def encode_all(self, texts):
        """(ids of all texts in a row, number of ids of each text).

        Where texts hold code points that not all versions of Unicode know, or the pattern is another, they are cut by the pattern itself.
        """
        if self.memory is not None:
            ids, sizes, odd = self.memory(texts)
            if not odd.any():
                return ids.astype(np.int32), sizes
            lists = np.split(ids, np.cumsum(sizes)[:-1])
        else:
            odd, lists = np.ones(len(texts), bool), [None] * len(texts)
        for k in np.flatnonzero(odd):
            lists[k] = np.array([i for x in self._pieces(self.pattern.findall(texts[k])) for i in x], np.int32)
        return np.concatenate([*lists, np.zeros(0, np.int32)]).astype(np.int32), np.array([len(x) for x in lists], np.int64)

    def encode(self, text):
        """Ids of one text."""
        return self.encode_all([text])[0].tolist()

    def decode_all(self, ids):
        """(bytes of all ids in a row, end of each id's bytes)."""
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.start[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        return np.frombuffer(self.whole.blob, np.uint8)[at], ends

    def decode(self, ids):
        return self.decode_all(np.array(ids, np.int64))[0].tobytes()


def _rebuilt(whole, pattern, table):
    codec = Codec.__new__(Codec)
    codec._set(whole, pattern, table)
    return codec


def _sent(spark, codec):
    """The codec of a Python worker, from one broadcast for both directions; a vocabulary has a fixed size, whatever the table's.

    It is kept where all tasks of a worker find it, with the pre-tokens it knows.
    """
    if codec.sent is None:
        codec.sent = spark.sparkContext.broadcast((codec.whole, codec.pattern.pattern, codec.table))
    sent, key = codec.sent, codec.key

    def here():
        kept = vars(sys).setdefault("_codecs_of_this_worker", {})
        if key not in kept:
            kept.clear()
            kept[key] = _rebuilt(*sent.value)
        return kept[key]

    return here


def encode(df, codec, text_col="text", ids_col="ids"):
    """``df`` with the token ids of the text as ``array<int>`` in place of a column ``ids_col``.

    A null text counts as empty and has no ids. Special tokens are ordinary text. A text of any length is encoded whole; it needs
    about 60 times its size. Rows are independent: repeated rows, other columns and an empty table pass through unchanged.
    """
    here = _sent(df.sparkSession, codec)
    rest = [c for c in df.columns if c != ids_col]
    # a column that only passes through does not go to Python twice
    at = rest.index(text_col)
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))])

    def work(piece):
        flat, sizes = here().encode_all([t or "" for t in piece.column(at).to_pylist()])
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        return pa.RecordBatch.from_arrays([*piece.columns, ids], names=[*piece.schema.names, ids_col])

    return over_texts(df.select(*[F.col(f"`{c}`") for c in rest]), at, work, schema, limit=PIECE_BYTES)


def decode(df, codec, ids_col="ids", out_col="decoded"):
    """``df`` with the bytes of the token ids in ``out_col``; no ids, or null, give no bytes."""
    here = _sent(df.sparkSession, codec)
    rest = [c for c in df.columns if c != out_col]
    at = rest.index(ids_col)
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(out_col, T.BinaryType())])

    def run(batches):
        codec = here()
        for rows in batches:
            sizes = np.nan_to_num(rows.column(at).value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            ends, first = np.cumsum(sizes), 0
            while first < rows.num_rows:
                stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + AT_ONCE, side="right")))
                some = rows.slice(first, stop - first)
                raw, upto = codec.decode_all(some.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                edges = np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(sizes[first:stop])])]
                out = pa.Array.from_buffers(pa.binary(), some.num_rows, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([*some.columns, out], names=[*rows.schema.names, out_col])
                first = stop

    return df.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)
