"""Cutting many texts into pre-tokens at once, by the public pattern of byte-level BPE.

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Code points fall into letters, numbers, white space and others. A pre-token is a run of one class, with these
additions: the last character of a run of white space before something else stands alone, or, if it is a blank,
joins what follows; a lone apostrophe without a blank takes an ending s, t, m, d, re, ve or ll with it.
"""

import unicodedata

import numpy as np
import regex

from .words import BASE, INVERSE, U, mix, powers

OTHER, LETTER, NUMBER, SPACE, UNASSIGNED = range(5)
LONGEST = 32  # code points of a pre-token that gets a name


def classes():
    """The class of every code point, as bytes.

    One that is unassigned in either of two versions of Unicode may be anything in a third, that of the tokenizer.
    """
    table = np.zeros(0x110000, np.uint8)
    for first in range(0, 0x110000, 0x8000):
        some = [c for c in range(first, first + 0x8000) if not 0xD800 <= c < 0xE000]
        text = "".join(map(chr, some))
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}"), (UNASSIGNED, r"\p{Cn}")):
            for m in regex.finditer(pattern + "+", text):
                table[some[m.start()]:some[m.end() - 1] + 1] = kind
    kinds = np.array([unicodedata.category(c) == "Cn" for c in map(chr, range(0x110000))])
    table[kinds] = UNASSIGNED
    table[0xD800:0xE000] = UNASSIGNED
    return table.tobytes()


class Cut:
    """Pre-tokens of a list of texts: ``starts`` and ``ends`` in code points of all texts together.

    ``first[i]`` is the first pre-token of text i, with the total at the end; ``names`` are 64-bit names of those of up to
    32 code points, ``long`` marks the others; ``odd`` marks texts with unassigned code points.
    """

    def __init__(self, texts, table):
        self.whole = "".join(texts)
        codes = np.frombuffer(self.whole.encode("utf-32-le"), np.uint32)
        n = len(codes)
        edges = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        kind = table[codes]
        odd = np.concatenate([[0], np.cumsum(kind == UNASSIGNED)])
        self.odd = odd[edges[1:]] > odd[edges[:-1]]
        opens = np.zeros(n + 1, bool)
        opens[edges] = True
        runs = np.flatnonzero(np.concatenate([kind[1:] != kind[:-1], [False]]) | opens[1:]) + 1 if n else np.zeros(0, np.int64)
        begin = np.concatenate([[0], runs[:-1]]) if n else runs
        end = runs
        cls = kind[begin] if n else kind
        last = opens[end]  # the run ends its text
        space = cls == SPACE
        cut_last = space & ~last  # its last character goes its own way
        blank = cut_last & (codes[end - 1] == 0x20) if n else cut_last
        mark = np.zeros(n + 1, bool)
        mark[begin] = True
        mark[end[cut_last] - 1] = True
        mark[end[blank]] = False  # what follows a blank begins with it
        alone = np.flatnonzero((end - begin == 1) & (cls == OTHER) & ~last)
        if len(alone):
            quote = alone[codes[begin[alone]] == 0x27]
            joined = np.concatenate([[False], blank[:-1]])
            quote = quote[~joined[quote]]
            quote = quote[cls[quote + 1] == LETTER]
            if len(quote):
                at = begin[quote + 1]
                size = end[quote + 1] - at
                one, two = codes[at], codes[np.minimum(at + 1, n - 1)]
                take = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
                pair = (size > 1) & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
                take[pair] = 2
                hit = take > 0
                at, size, take = at[hit], size[hit], take[hit]
                mark[at] = False
                rest = take < size
                mark[(at + take)[rest]] = True
        mark[n] = False
        self.starts = np.flatnonzero(mark)
        self.ends = np.concatenate([self.starts[1:], [n]]) if len(self.starts) else self.starts
        self.first = np.searchsorted(self.starts, edges)
        self.long = self.ends - self.starts > LONGEST
        total = np.zeros(n + 1, U)
        np.cumsum(mix(codes.astype(U) + U(1)) * powers(BASE, n)[:n], out=total[1:])
        self.names = mix((total[self.ends] - total[self.starts]) * powers(INVERSE, n)[self.starts] + (self.ends - self.starts).astype(U))

    def text(self, k):
        return self.whole[self.starts[k]:self.ends[k]]


class _Names:
    """Sorted names with a number each; new ones are merged in when there are many."""

    def __init__(self, names=None, numbers=None):
        self.names = np.zeros(0, U) if names is None else names
        self.numbers = np.zeros(0, np.int64) if numbers is None else numbers

    def find(self, names):
        """The number of each name, or -1."""
        if not len(self.names):
            return np.full(len(names), -1)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, self.numbers[at], -1)

    def with_more(self, names, numbers):
        names, numbers = np.concatenate([self.names, names]), np.concatenate([self.numbers, numbers])
        order = np.argsort(names, kind="stable")
        return _Names(names[order], numbers[order])


class Memory:
    """Ids of pre-tokens seen before, asked from ``encode(list of strings) -> list of id lists`` once each.

    Bounded: it starts anew when it holds ``limit`` pre-tokens. Names of 64 bits stand for pre-tokens of up to 32 code points;
    longer ones are asked anew each time.
    """

    FRESH = 1 << 15

    def __init__(self, encode, table, limit=1_000_000):
        self.encode, self.table, self.limit = encode, np.frombuffer(table, np.uint8), limit
        self._clear()

    def _clear(self):
        self.old, self.fresh = _Names(), _Names()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.offsets, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.count = 0

    def _learn(self, texts):
        """Numbers of new entries for these pre-tokens."""
        found = self.encode(texts)
        sizes = np.array([len(x) for x in found], np.int64)
        total, n = int(sizes.sum()), len(found)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + n > len(self.offsets):
            self.offsets, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offsets, self.sizes))
        self.flat[self.used:self.used + total] = [i for x in found for i in x]
        self.offsets[self.count:self.count + n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.count:self.count + n] = sizes
        numbers = np.arange(self.count, self.count + n)
        self.used, self.count = self.used + total, self.count + n
        return numbers

    def __call__(self, texts):
        """(ids of all texts in a row, number of ids of each text, is it odd), for texts without special tokens."""
        cut = Cut(texts, self.table)
        if self.count > self.limit:
            self._clear()
        which = np.empty(len(cut.starts), np.int64)
        some, far = np.flatnonzero(~cut.long), np.flatnonzero(cut.long)
        names, index, inverse = np.unique(cut.names[some], return_index=True, return_inverse=True)
        place = self.old.find(names)
        unseen = np.flatnonzero(place < 0)
        place[unseen] = self.fresh.find(names[unseen])
        unseen = np.flatnonzero(place < 0)
        if len(unseen):
            place[unseen] = self._learn([cut.text(k) for k in some[index[unseen]]])
            self.fresh = self.fresh.with_more(names[unseen], place[unseen])
            if len(self.fresh.names) > self.FRESH:
                self.old, self.fresh = self.old.with_more(self.fresh.names, self.fresh.numbers), _Names()
        which[some] = place[inverse]
        if len(far):
            which[far] = self._learn([cut.text(k) for k in far])
        each = self.sizes[which].astype(np.int64)
        ends = np.cumsum(each)
        out = self.flat[np.repeat(self.offsets[which] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return out, np.diff(np.concatenate([[0], ends])[cut.first]), cut.odd
