"""Quality rules on repetition.

A rolling hash names the word n-grams of all lengths: one running sum over the words, of which a window is
the difference of two places. N-grams are compared inside each text; the rules look at the share of word characters inside n-grams, and of text inside lines, that occur
more than once. One pass over the texts, no shuffle.
"""

import numpy as np
import pyarrow as pa

from .arrow import SMALL_BYTES, Texts, batch, over_texts
from .words import BASE, INVERSE, U, Words, covered, mix, per_row, powers, repeated, span_names, table

BASE_WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: n-gram length: largest share of word characters in n-grams found twice or more
MAX_NGRAM_SHARE = {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15}
#: largest share of lines, and of their bytes, that equal an earlier line
MAX_LINE_SHARE = 0.30
MAX_LINE_BYTES_SHARE = 0.30

SYMBOLS = table(b"#*$%&|<>")
SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "dup_line_share double, dup_line_bytes_share double, dup_char_shares array<double>, "
          "base_failed boolean, kept boolean")


def _lines(texts, words):
    """Per row: lines with a word, those equal to an earlier one, and their bytes."""
    data = texts.data
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([texts.offsets[:-1][texts.sizes > 0], breaks + 1]))
    starts = starts[starts < len(data)]
    row = np.searchsorted(texts.offsets, starts, side="right") - 1
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    # a line ends before its break, or where its text ends
    ends = np.where((ends > starts) & (data[np.maximum(ends, 1) - 1] == 10), ends - 1, ends) if len(starts) else ends
    worded = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, row = starts[worded], ends[worded], row[worded]
    keys = per_row(span_names(data, starts, ends), row)
    later = np.ones(len(keys), bool)
    later[np.unique(keys, return_index=True)[1]] = False
    count = lambda weights: np.bincount(row, weights, texts.n)
    return count(None), count(later), count(later * (ends - starts)), count(ends - starts)


class Rolling:
    """Names of all runs of words from one running polynomial hash, moved to a common start."""

    def __init__(self, names):
        self.n = len(names)
        self.total = np.zeros(self.n + 1, U)
        np.cumsum(names * powers(BASE, self.n)[:self.n], out=self.total[1:])

    def of(self, width):
        """The name of each run of ``width`` neighbours."""
        m = max(self.n - width + 1, 0)
        return mix((self.total[width:width + m] - self.total[:m]) * powers(INVERSE, self.n)[:m] + U(width))


def measures(texts):
    words = Words(texts)
    rolling = Rolling(words.names)
    n_words = words.counts
    # bytes that begin a code point; words are whole code points
    begins = (texts.data & 0xC0) != 0x80
    word_chars = texts.sums(begins & words.inside)
    letters = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
    width_chars = letters[words.ends] - letters[words.starts]
    lines, dup_lines, dup_bytes, line_bytes = _lines(texts, words)

    def twice(width, only=None):
        names = rolling.of(width)
        inside = words.row[:len(names)] == words.row[width - 1:] if len(names) else np.zeros(0, bool)
        if only is not None:
            inside &= only[words.row[:len(names)]]
        at = np.flatnonzero(inside)
        names = names[at]
        return covered(len(words.names), at[repeated(per_row(names, words.row[at]))], width)

    base = twice(BASE_WINDOW)
    n_repeat = np.bincount(words.row, base, texts.n).astype(np.int64)
    shares = []
    suspects = n_repeat > 0  # a longer n-gram that repeats holds shorter ones that do
    for width in MAX_NGRAM_SHARE:
        inside = base if width == BASE_WINDOW else twice(width, suspects) if suspects.any() else np.zeros(len(base), bool)
        chars = np.bincount(words.row, inside * width_chars, texts.n)
        shares.append(chars / np.maximum(word_chars, 1))
    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    line_share, bytes_share = dup_lines / np.maximum(lines, 1), dup_bytes / np.maximum(line_bytes, 1)
    bad = base_failed | (line_share > MAX_LINE_SHARE) | (bytes_share > MAX_LINE_BYTES_SHARE)
    for share, most in zip(shares, MAX_NGRAM_SHARE.values()):
        bad = bad | (share > most)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": texts.sums(SYMBOLS[texts.data]),
        "n_dup_lines": dup_lines.astype(np.int64), "n_repeat_words": n_repeat,
        "dup_line_share": line_share, "dup_line_bytes_share": bytes_share,
        "dup_char_shares": list(np.stack(shares, 1)) if texts.n else [],
        "base_failed": base_failed, "kept": ~bad,
    }


def judge(docs, id_col="doc_id", text_col="text"):
    """Repetition measures and a verdict for each row.

    Null, empty and blank texts have no words, all counts 0, and fail. A text of any length is judged whole, in memory
    of about 60 times its size. Repeated rows and null ids are judged row by row, ids may be of any type; an empty table gives an empty one. Only the two named
    columns are read, whatever others there are.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(piece):
        return batch(id=piece.column(0), **measures(Texts(piece.column(1))))

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return over_texts(rows, 1, work, f"id {kind}, {SCHEMA}", limit=SMALL_BYTES).withColumnRenamed("id", id_col)


def passing(docs, text_col="text"):
    """The rows of ``docs`` that the rules keep, with all their columns and no others.

    The rows travel through the operator whole, so no join is needed.
    """
    at = docs.columns.index(text_col)
    schema = docs.schema

    def work(piece):
        keep = measures(Texts(piece.column(at)))["kept"]
        return piece.filter(pa.array(keep)) if keep.any() else None

    return over_texts(docs, at, work, schema, limit=SMALL_BYTES)
