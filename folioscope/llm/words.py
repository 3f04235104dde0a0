"""Words of many texts at once, named by 64-bit fingerprints of their bytes."""

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))


def mix(x):
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_powers = {}


def powers(base, n):
    """base**0 .. base**n modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        steps = np.full(size, base, U)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have


def span_names(data, starts, ends, values=BYTE_VALUES):
    """Fingerprints of the byte spans [start, end): equal bytes, equal names."""
    if not len(starts):
        return np.zeros(0, U)
    n = len(data)
    total = np.zeros(n + 1, U)
    np.cumsum(values[data] * powers(BASE, n)[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * powers(INVERSE, n)[starts] + (ends - starts).astype(U))


def run_names(names, width):
    """Name of each run of ``width`` neighbours; run i covers i .. i + width - 1."""
    n = len(names) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(width):
        out *= BASE
        out += names[j:j + n]
    return mix(out)


def table(pattern_members):
    """Byte table that is true for the given byte values."""
    out = np.zeros(256, bool)
    out[list(pattern_members)] = True
    return out


SPACE = table([0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


class Words:
    """Maximal runs of bytes that are no white space, text by text.

    ``starts``, ``ends``: byte spans; ``names``: fingerprints; ``row``: row of each word;
    ``first``: index of each row's first word, with the total at the end.
    """

    def __init__(self, texts, lower=False):
        data = LOWER[texts.data] if lower else texts.data
        inside = ~SPACE[data]
        n = len(data)
        opens = np.zeros(n + 1, bool)
        opens[texts.offsets] = True  # a word never crosses into the next text
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.inside = inside
        self.starts = np.flatnonzero(inside & (~before | opens[:n]))
        self.ends = np.flatnonzero(inside & (~after | opens[1:])) + 1
        self.names = span_names(data, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, texts.offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(texts.n), self.counts)

    def windows(self, width):
        """(index of the first word, name) of every run of ``width`` words of one text."""
        names = run_names(self.names, width)
        at = np.flatnonzero(self.row[:len(names)] == self.row[width - 1:]) if len(names) else np.zeros(0, np.int64)
        return at, names[at]


def per_row(names, rows):
    """Names that differ between rows, so that one sort serves all rows of a piece."""
    return mix(names + mix(rows.astype(U) + U(1)))


def repeated(keys):
    """True for every key that occurs more than once."""
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def covered(n, starts, width):
    """True for the places 0 .. n-1 inside any [start, start + width)."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:n]) > 0
