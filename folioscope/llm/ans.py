"""Static range asymmetric numeral system (rANS) for token ids, on NumPy lanes.

All blocks share one table of frequencies that add up to 2**20. A block is independent: 32
interleaved 64-bit states take turns over its ids and share one stream of 32-bit words. Every
16,384 ids a checkpoint keeps the states and the place in the stream, so the segments between
checkpoints decode side by side, each with a checksum of its own.
"""

import struct
import zlib

import numpy as np

U = np.uint64
BITS = 20
TOTAL = 1 << BITS
LANES = 32
STEPS = 512  # steps between checkpoints: 16,384 ids
LOW = U(1 << 31)  # a state is at least this after each step, and below 2**63
HEAD = "<4sQHIIQ"  # mark, ids, lanes, segments, bytes of the index, words
MARK = b"RANB"


class Damaged(ValueError):
    """A block whose bytes or ids do not fit their checksums."""


def frequencies(counts):
    """Frequencies that add up to 2**20, at least one for every token that occurs."""
    counts = np.asarray(counts, np.float64)
    there = np.flatnonzero(counts > 0)
    out = np.zeros(len(counts), np.int64)
    if not len(there):
        return out
    if len(there) > TOTAL // 2:
        raise ValueError(f"{len(there)} different tokens, the table holds {TOTAL // 2}")
    share = counts[there] / counts.sum() * TOTAL
    freq = np.maximum(1, np.floor(share).astype(np.int64))
    left = TOTAL - int(freq.sum())
    if left > 0:  # to the largest remainders
        order = np.argsort(np.floor(share) - share, kind="stable")
        np.add.at(freq, order[np.arange(left) % len(order)], 1)
    while left < 0:  # from the frequent ones, in proportion
        spare = freq - 1
        take = np.minimum(spare, -(spare * left // spare.sum()))
        gone = np.cumsum(take)
        take = np.where(gone <= -left, take, np.maximum(0, take - (gone + left)))
        freq -= take
        left += int(take.sum())
    out[there] = freq
    return out


class Model:
    """Frequencies with what both directions look up."""

    def __init__(self, freq):
        self.freq = np.asarray(freq, np.int64).astype(U)
        self.first = np.concatenate([[0], np.cumsum(self.freq, dtype=U)[:-1]]).astype(U) if len(freq) else np.zeros(0, U)
        self.crc = zlib.crc32(np.asarray(freq, "<u4").tobytes())
        self._slots = None

    @property
    def slots(self):
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode(blocks, model, indexes):
    """Bytes of each block of ids; ``indexes`` are bytes carried along. All blocks advance together."""
    n = np.array([len(b) for b in blocks], np.int64)
    steps = int(-(-n.max() // LANES)) if len(n) else 0
    g = len(blocks)
    ids = np.zeros((steps * LANES, g), np.int64)
    for k, b in enumerate(blocks):
        ids[:len(b), k] = b
    # (step, block, lane)
    ids = ids.reshape(steps, LANES, g).transpose(0, 2, 1)
    full = n // LANES  # steps in which all lanes of a block are busy
    lane = np.arange(LANES)
    x = np.full((g, LANES), LOW, U)
    words = np.zeros((steps, g, LANES), np.uint32)
    sent = np.zeros((steps, g, LANES), bool)
    marks = np.zeros((-(-steps // STEPS), g, LANES), U)
    whole = int(full.min()) if g else 0
    shift, half, room = U(BITS), U(32), U(63 - BITS)
    for s in range(steps - 1, -1, -1):
        now = ids[s]
        f, c = model.freq[now], model.first[now]
        if s >= whole:
            busy = s * LANES + lane[None, :] < n[:, None]
            if (f[busy] == 0).any():
                raise ValueError("a token that is not in the frequency table")
            f = np.where(busy, f, U(1))
            out = busy & (x >= f << room)
        else:
            if not f.all():
                raise ValueError("a token that is not in the frequency table")
            out = x >= f << room
        words[s] = x.astype(np.uint32)  # the low half
        sent[s] = out
        y = np.where(out, x >> half, x)
        q = y // f
        y = (q << shift) + (y - q * f) + c
        x = np.where(busy, y, x) if s >= whole else y
        if s % STEPS == 0:
            marks[s // STEPS] = x
    result = []
    for k, b in enumerate(blocks):
        own = int(-(-len(b) // LANES))
        segments = -(-own // STEPS)
        each = sent[:own, k].sum(1)
        place = np.concatenate([[0], np.cumsum(each)])[:-1][::STEPS][:segments] if own else np.zeros(0)
        stream = words[:own, k][sent[:own, k]]
        raw = np.asarray(b, "<u4")
        size = STEPS * LANES
        crcs = [zlib.crc32(raw[i * size:(i + 1) * size].tobytes()) for i in range(segments)]
        body = b"".join([
            struct.pack(HEAD, MARK, len(b), LANES, segments, len(indexes[k]), len(stream)), indexes[k],
            np.array(crcs, "<u4").tobytes(), place.astype("<u8").tobytes(), marks[:segments, k].astype("<u8").tobytes(), stream.astype("<u4").tobytes()])
        result.append(body + struct.pack("<I", zlib.crc32(body)))
    return result


class Block:
    """The parts of an encoded block, after a test of its checksum."""

    def __init__(self, data):
        if len(data) < struct.calcsize(HEAD) + 4 or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise Damaged("the bytes of a block do not fit their checksum")
        mark, self.n, lanes, self.segments, index, words = struct.unpack_from(HEAD, data)
        if mark != MARK or lanes != LANES:
            raise Damaged("not a block of this format")
        at = struct.calcsize(HEAD)
        self.index = data[at:at + index]
        at += index

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.crcs = take("<u4", self.segments)
        self.places = take("<u8", self.segments).astype(np.int64)
        self.states = take("<u8", self.segments * LANES).reshape(self.segments, LANES)
        self.words = take("<u4", words)


def decode(wanted, model):
    """Ids of each (block, first segment, end segment): all segments of all blocks side by side."""
    size = STEPS * LANES
    rows = [(k, s) for k, (b, lo, hi) in enumerate(wanted) for s in range(lo, hi)]
    if not rows:
        return [np.zeros(0, np.uint32) for _ in wanted]
    before = np.concatenate([[0], np.cumsum([len(b.words) for b, _, _ in wanted])])
    words = np.concatenate([*[b.words for b, _, _ in wanted], np.zeros(1, np.uint32)]).astype(U)
    x = np.stack([wanted[k][0].states[s] for k, s in rows]).astype(U)
    at = np.array([before[k] + wanted[k][0].places[s] for k, s in rows], np.int64)
    n = np.array([min(size, wanted[k][0].n - s * size) for k, s in rows], np.int64)
    # the longest first, so that those still running are the front rows
    order = np.argsort(-n, kind="stable")
    x, at, left = x[order], at[order], n[order]
    out = np.zeros((len(rows), size), np.uint32)
    lane = np.arange(LANES)
    mask, shift, half = U(TOTAL - 1), U(BITS), U(32)
    slots, freq, first = model.slots, model.freq, model.first
    for step in range(int(-(-left[0] // LANES))):
        live = int(np.searchsorted(-left, -step * LANES, side="left"))
        y = x[:live]
        slot = y & mask
        sym = slots[slot.astype(np.int64)]
        z = freq[sym] * (y >> shift) + slot - first[sym]
        if left[live - 1] < (step + 1) * LANES:
            busy = step * LANES + lane[None, :] < left[:live, None]
            z = np.where(busy, z, y)
            need = busy & (z < LOW)
        else:
            need = z < LOW
        out[:live, step * LANES:(step + 1) * LANES] = sym
        count = np.cumsum(need, axis=1)
        where = at[:live, None] + count - 1
        read = words[np.where(need, where, -1)]
        x[:live] = np.where(need, (z << half) | read, z)
        at[:live] += count[:, -1]
    result = [[] for _ in wanted]
    back = np.empty(len(rows), np.int64)
    back[order] = np.arange(len(rows))
    for r, (k, s) in enumerate(rows):
        ids = out[back[r], :n[r]]
        if zlib.crc32(ids.astype("<u4").tobytes()) != wanted[k][0].crcs[s]:
            raise Damaged("the ids of a segment do not fit their checksum")
        result[k].append(ids)
    return [np.concatenate(r) if r else np.zeros(0, np.uint32) for r in result]
