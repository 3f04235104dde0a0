"""Text expressions. All of them are native columns; none calls Python per row."""

import re

from pyspark.sql import Column, functions as F

from .. import fixed_values as V

# The characters Python's str.strip() and str.split() treat as white space. Spark's
# trim() cuts plain spaces only.
WHITE_SPACE = "".join(
    chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                     *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
_SPACE_CLASS = r"\s\x1c-\x1f"  # the same set under (?U)
_SPACE_RUN = f"(?U)[{_SPACE_CLASS}]+"

# Letters, digits and underscore: the same set in Java and in RE2, unlike \w.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"

# "Ten or more dots or spaces, more spaces, digits" holds exactly where ten such
# characters stand right before a digit. Looking back from a digit has no nested repeat,
# so long runs cannot exhaust the regex stack, and text without digits is passed quickly.
LEADER_PATTERN = rf"(?U)\d(?<=[.{_SPACE_CLASS}]{{10}}\d)"


def strip(col) -> Column:
    return F.btrim(col, F.lit(WHITE_SPACE))


def one_line(col) -> Column:
    """Stripped text with line breaks turned to spaces."""
    return F.replace(strip(col), F.lit("\n"), F.lit(" "))


def null_words_to_null(col, words=None) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.when(~col.isin(list(V.NULL_WORDS if words is None else words)), col)


def first_words(col, n=V.SNIPPET_WORDS) -> Column:
    """The first ``n`` words joined by single spaces; the rest is never split."""
    pieces = F.split(strip(col), _SPACE_RUN, n + 1)
    return F.array_join(F.slice(pieces, 1, n), " ")


def short_label(col, n=V.LABEL_CHARS) -> Column:
    return F.concat(F.substring(col, 1, n), F.lit("..."))


def fill_template(template, **parts) -> Column:
    """A ``{name}`` template as one concat of literals and columns."""
    out = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece.startswith("{") and piece.endswith("}"):
            out.append(parts[piece[1:-1]])
        elif piece:
            out.append(F.lit(piece))
    return F.concat(*out)


def keyword_count(col) -> Column:
    """Comma pieces; an empty string counts one, null stays null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col.isNotNull(), F.size(F.split(col, ",")))


def tokens(col) -> Column:
    """Lower-case words of two or more characters."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD_PATTERN), F.lit(0))


def ngrams(words, sizes=(2, 2)) -> Column:
    """All n-grams of the sizes ``sizes[0]..sizes[1]`` of a word array."""
    words = F.col(words) if isinstance(words, str) else words

    def of(n):
        grams = F.transform(
            F.sequence(F.lit(0), F.size(words) - n),
            lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(n)]),
        )
        return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(sizes[0], sizes[1] + 1)])


def stop_words(words=None, extra=None):
    """The Portuguese stop words, or ``words``, plus the domain words."""
    words = V.PORTUGUESE_STOP_WORDS if words is None else words
    return sorted({*words, *(V.DOMAIN_STOP_WORDS if extra is None else extra)})


def is_relevant(col, phrases=None, min_length=V.MIN_TEXT_LENGTH) -> Column:
    """True for a text worth annotating: no stop phrase, no leader, long enough."""
    def keep(low):
        ok = F.length(low) >= min_length
        for phrase in V.TEXT_STOP_PHRASES if phrases is None else phrases:
            ok = ok & ~F.contains(low, F.lit(phrase))
        return ok & ~F.rlike(low, F.lit(LEADER_PATTERN))

    # A filter evaluates each of its terms on its own; binding the lower-case text once
    # keeps a list of phrases from lowering it once per phrase.
    return F.exists(F.array(F.lower(col)), keep)


def longer_than(col, length=V.MIN_TEXT_LENGTH) -> Column:
    """The older rule: only the length counts, and the bound itself is dropped."""
    return F.length(col) > length


def literal(text):
    """``text`` as a regex that means itself. Plain text stays as it is, which lets a
    one-character separator take the split without a regex."""
    return text if not re.search(r"[\\^$.|?*+()\[\]{}]", text) else f"\\Q{text}\\E"


def _after(col, marker, stop=None):
    """Text after the first ``marker``, up to its next repeat and up to ``stop``."""
    part = F.get(F.split(col, literal(marker), 3), 1)
    if stop is not None:
        part = F.get(F.split(part, literal(stop), 2), 0)
    return strip(part)


def answer_summary(col, markers=None, stop=V.KEYWORDS_MARKER, missing=V.MISSING_PART) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    found = [_after(col, m, stop) for m in (markers or V.SUMMARY_MARKERS)]
    return F.when(col.isNotNull(), F.coalesce(*found, F.lit(missing)))


def answer_keywords(col, marker=V.KEYWORDS_MARKER, missing=V.MISSING_PART) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col.isNotNull(), F.coalesce(_after(col, marker), F.lit(missing)))
