"""Personal data replaced by surrogates of the same kind.

An entity is normalised, so that its spellings share one surrogate. Its surrogate is drawn
by a keyed hash from the values of its kind: same script, case and length, digits for
digits, a given name of the same gender. Spark then checks all surrogates of the corpus
at once: one that equals another entity's surrogate, or any real entity, is drawn anew.
Every few draws the values to draw from become more, so that no kind is ever used up.
"""

import functools
import hashlib
import hmac
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F, types as T

from .shared import stored

MAX_BROADCAST_BYTES = 16 << 20
WIDEN = 4  # draws after which a surrogate gets one more character, or an address a larger range

# --- fixed values: titles by gender, and given names by script and gender ------------
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Господин", "г-н"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "г-жа"],
    "n": ["Dr", "Prof"],
}
GIVEN = {
    "latin": {
        "m": ["James", "Robert", "John", "Michael", "David", "Thomas", "Peter", "Paul", "Hans", "Karl", "Pierre",
              "Jean", "Louis", "Carlos", "Miguel", "Pablo"],
        "f": ["Mary", "Linda", "Susan", "Anna", "Sarah", "Laura", "Emma", "Julia", "Greta", "Heidi", "Marie",
              "Claire", "Sophie", "Carmen", "Lucia", "Elena"],
    },
    "cyrillic": {
        "m": ["Иван", "Пётр", "Алексей", "Дмитрий", "Сергей", "Николай", "Михаил", "Андрей"],
        "f": ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана"],
    },
}
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se ta te to va ve za".split(),
    "cyrillic": "ба бе бо да де до ва ве го ка ко ла ле ли ло ма ме ми мо на не ни но ра ре ро са се та те то".split(),
}
ALPHABETS = {
    "latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω",
}
GENDER_OF = {name.casefold(): g for by in GIVEN.values() for g, names in by.items() for name in names}

EMAIL_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)+")
IPV4 = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}[.-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\w)|(?<![\w.-])(?<!\d )\d{3} \d{3} \d{4}(?!\w| \d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
CARD = r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?!\w)"
NUMBERS = re.compile(f"(?P<ip>{IPV4})|(?P<phone>{PHONE})|(?P<ssn>{SSN})|(?P<card>{CARD})", re.ASCII)
SECRET = re.compile(r"(?<!\w)(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|ghp_\w{36}|sk-[\w-]{20,})(?!\w)", re.ASCII)
KEYED = re.compile(r"(?i)\b(?:token|secret|password|api[_-]?key)\b[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_+/-]{12,})")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.ASCII)
_TITLE_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
NAME = re.compile(r"(?<!\w)(%s)\.? ((?:[^\W\d_][\w'’-]*)(?: [^\W\d_][\w'’-]*){0,2})" % "|".join(sorted(_TITLE_GENDER, key=len, reverse=True)))
ANY_TITLE = re.compile("|".join(sorted(_TITLE_GENDER)))
DIGIT = re.compile(r"[0-9]")


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _iban_ok(value):
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def script(text):
    for c in text.casefold():
        for name, letters in ALPHABETS.items():
            if c in letters:
                return name
    return "latin"


def _normal(kind, raw):
    if kind in ("phone", "ssn", "card"):
        return re.sub(r"[^0-9+]", "", raw)
    if kind == "iban":
        return raw.replace(" ", "")
    if kind == "email" or kind.startswith(("given", "family")):
        return raw.casefold() if len(raw.casefold()) == len(raw) else raw
    return raw


def _local_part(text, at):
    """Where the characters before ``at`` that may be the local part of an address begin."""
    while at and (text[at - 1].isalnum() or text[at - 1] in "_.+-"):
        at -= 1
    return at


def mentions(text):
    """(start, end, kind, normal form) of the entities of a text, in order, not overlapping.

    Kinds: email, ip, phone, ssn, card, secret, iban, and the parts of titled names: given:m,
    given:f, given:n, family. A part of a titled name counts wherever the text repeats it.
    """
    if not text:
        return []
    found = []
    at = text.find("@")
    while at >= 0:
        tail = EMAIL_DOMAIN.match(text, at + 1)
        start = _local_part(text, at) if tail else at
        if start < at and text[at - 1] != ".":
            found.append((start, tail.end(), "email"))
        at = text.find("@", at + 1)
    if DIGIT.search(text):
        found += [(m.start(), m.end(), m.lastgroup) for m in NUMBERS.finditer(text)]
        found += [(m.start(), m.end(), "secret") for m in SECRET.finditer(text)]
        found += [(m.start(1), m.end(1), "secret") for m in KEYED.finditer(text) if DIGIT.search(m[1])]
        found += [(m.start(), m.end(), "iban") for m in IBAN.finditer(text) if _iban_ok(m[0].replace(" ", ""))]
    if ANY_TITLE.search(text):
        found += _names(text)
    out, reached = [], 0
    for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if a >= reached:
            out.append((a, b, kind, _normal(kind, text[a:b])))
            reached = b
    return out


def _names(text):
    parts = {}  # spelling: kind
    for m in NAME.finditer(text):
        words = []
        for w in m[2].split(" "):
            if not w[0].isupper():
                break
            words.append(w)
        gender = _TITLE_GENDER[m[1]]
        for w in words[:-1]:
            parts.setdefault(w, f"given:{gender if gender != 'n' else GENDER_OF.get(w.casefold(), 'n')}")
        if words:
            parts[words[-1]] = "family"
    if not parts:
        return []
    again = re.compile(r"(?<!\w)(?:%s)(?!\w)" % "|".join(map(re.escape, sorted(parts, key=len, reverse=True))), re.IGNORECASE)
    folded = {w.casefold(): kind for w, kind in sorted(parts.items(), reverse=True)}
    # a word in lower case may be no name
    return [(m.start(), m.end(), folded[m[0].casefold()]) for m in again.finditer(text) if m[0][0].isupper() and m[0].casefold() in folded]


@functools.lru_cache(1024)
def _caseless(script_name, block):
    """Letters without case of one script in a block of 256."""
    return [c for c in map(chr, range(block * 256, block * 256 + 256))
            if unicodedata.category(c) == "Lo" and unicodedata.name(c, "").split(" ")[0].split("-")[0] == script_name]


class _Draw:
    """Numbers from a keyed hash."""

    def __init__(self, key, *parts):
        self.key, self.parts, self.turn, self.pool = key, "\x1f".join(map(str, parts)), 0, 0
        self.left = 0

    def below(self, n):
        if self.left < 32:
            block = hmac.new(self.key, f"{self.parts}\x1f{self.turn}".encode(), hashlib.sha256).digest()
            self.pool, self.left, self.turn = int.from_bytes(block, "big"), 256, self.turn + 1
        self.pool, value = divmod(self.pool, 1 << 32)
        self.left -= 32
        return value * n >> 32

    def like(self, c):
        """A character of the same class."""
        if c in "0123456789":
            return "0123456789"[self.below(10)]
        if not c.isalpha():
            digit = unicodedata.decimal(c, None)
            return c if digit is None else chr(ord(c) - digit + self.below(10))
        low = c.lower()
        if ord(c) > 0x250 and low not in "".join(ALPHABETS.values()) and not c.isupper() and not c.islower():
            same = _caseless(unicodedata.name(c, "").split(" ")[0].split("-")[0], ord(c) // 256)
            return same[self.below(len(same))] if same else c
        letters = ALPHABETS[next((s for s, a in ALPHABETS.items() if low in a), "latin")]
        drawn = letters[self.below(len(letters))]
        return drawn.upper() if c.isupper() else drawn


def surrogate(key, kind, value, draw):
    """The surrogate of a normal form at its ``draw``-th draw.

    Every ``WIDEN`` draws it gets one more character; an address first leaves its own range
    for a larger one and then IPv4. So its possible values grow until there is a free one.
    """
    d = _Draw(key, kind, value, draw)
    more = draw // WIDEN
    if kind == "ip":
        if more > 1:  # a unique local address: 120 bits
            return "fd%02x:" % d.below(256) + ":".join("%x" % d.below(1 << 16) for _ in range(7))
        if more and value.startswith(("192.168.", "127.")):
            value = "10." + value
        keep = next((p for p in ("10.", "192.168.", "127.") if value.startswith(p)), "")
        octets = value[len(keep):].split(".")[-3 if keep == "10." else 0:]
        return keep + ".".join(str(1 + d.below(254)) for _ in octets)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels, dot, top = domain.rpartition(".")
        return "".join(map(d.like, "a" * more + local)) + "@" + "".join(map(d.like, labels)) + dot + top
    if kind == "phone" and value.startswith("+"):
        keep = 2 if value[1] in "17" else 3  # the country code, as far as its first digit tells
        return value[:keep] + "".join(map(d.like, value[keep:] + "0" * more))
    if kind == "card":
        body = value[0] + "".join(map(d.like, value[1:-1] + "0" * more))
        ends = [c for c in "0123456789" if _luhn(body + c) == _luhn(value)]
        return body + ends[d.below(len(ends))]
    if kind == "iban":
        body = "".join(map(d.like, value[4:] + "0" * more))
        check = 98 - int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{check:02d}{body}"
    if kind == "secret":
        if re.fullmatch(r"[0-9a-f]+", value):
            return "".join("0123456789abcdef"[d.below(16)] for _ in range(len(value) + more))
        if re.fullmatch(r"[0-9A-F]+", value):
            return "".join("0123456789ABCDEF"[d.below(16)] for _ in range(len(value) + more))
        keep = next((p for p in ("AKIA", "ghp_", "sk-") if value.startswith(p)), "")
        return keep + "".join(map(d.like, value[len(keep):] + "0" * more))
    if kind.startswith(("given", "family")):
        s = script(value)
        if s not in SYLLABLES:
            return "".join(map(d.like, value + ALPHABETS[s][0] * more))
        gender = kind[6:]
        if kind != "family" and draw == 0:
            names = GIVEN[s].get(gender) or GIVEN[s]["m"] + GIVEN[s]["f"]
            return names[d.below(len(names))].casefold()
        made = "".join(SYLLABLES[s][d.below(len(SYLLABLES[s]))] for _ in range(3 + draw // 4))
        ending = {"f": {"latin": "a", "cyrillic": "а"}, "m": {"latin": "n", "cyrillic": "н"}}.get(gender, {}).get(s, "")
        return made + ending
    return "".join(map(d.like, value + "0" * more))


def _dressed(kind, raw, made):
    """A surrogate in the spelling of the mention: its separators and its case."""
    if kind in ("phone", "ssn", "card", "iban"):
        it = iter(made)
        return "".join([c if c in " ().-" else next(it) for c in raw] + [*it])
    if kind == "email":
        more = len(made) - len(raw)
        return made[:more] + "".join(m.upper() if c.isupper() else m for c, m in zip(raw, made[more:]))
    if kind.startswith(("given", "family")):
        if raw.isupper() and len(raw) > 1:
            return made.upper()
        return made[:1].upper() + made[1:] if raw[:1].isupper() else made
    return made


def replaced(text, key, later):
    """(new text, [(start, end, kind, surrogate)]); ``later`` gives the draw of an entity."""
    out, spans, at = [], [], 0
    for a, b, kind, value in mentions(text):
        new = _dressed(kind, text[a:b], surrogate(key, kind, value, later.get((kind, value), 0)))
        out += [text[at:a], new]
        spans.append((a, b, kind, new))
        at = b
    out.append(text[at:] if text else "")
    return "".join(out), spans


def entities(docs, text_col="text"):
    """Distinct (kind, value) of all texts; summed up within tasks before the shuffle."""
    def run(batches):
        for rows in batches:
            seen = {(k, v) for t in rows.column(0).to_pylist() for _, _, k, v in mentions(t)}
            yield pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _ in seen], pa.string()),
                                              "value": pa.array([v for _, v in seen], pa.string())})

    text = docs.select(docs[text_col].cast("string").alias("text"))
    return text.mapInArrow(run, "kind string, value string").distinct()


def redrawn(found, key):
    """(kind, value, draw) of the entities whose first surrogate is taken.

    Of entities with equal surrogates the smallest keeps it. A surrogate that is the value
    of a real entity is nobody's; all parts of names are held against each other. The others draw again until all surrogates differ, which
    happens because the values of every kind grow with the draws.
    """
    def drawn(rows):
        def run(batches):
            for b in batches:
                made = [surrogate(key, k, v, n) for k, v, n in zip(*(b.column(c).to_pylist() for c in ("kind", "value", "draw")))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, "made"])

        return rows.mapInArrow(run, "kind string, value string, draw int, made string")

    # parts of names are told apart from each other, whichever part they are
    space = F.when(F.col("kind").startswith("given") | (F.col("kind") == "family"), "name").otherwise(F.col("kind"))
    taken = found.select(space.alias("space"), F.col("value").alias("made")).distinct()
    pending, n = found.withColumn("draw", F.lit(0)), found.count()
    parts = []
    while True:
        tried = stored(drawn(pending), "drawn", n)
        won = (tried.groupBy(space.alias("space"), "made").agg(F.min(F.struct("value", "kind", "draw")).alias("first"))
               .join(taken, ["space", "made"], "left_anti"))
        won = stored(won.select("space", "first.kind", "first.value", "first.draw", "made"), "surrogates", n)
        parts.append(won)
        lost = tried.join(won, ["kind", "value"], "left_anti").select("kind", "value", (F.col("draw") + 1).alias("draw"))
        pending = stored(lost, "pending", n)
        n = pending.count()
        if not n:
            later = parts[1:]
            if not later:
                return None
            out = later[0]
            for p in later[1:]:
                out = out.union(p)
            return out.select("kind", "value", "draw")
        taken = taken.union(won.select("space", "made"))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                  T.StructField("kind", T.StringType()), T.StructField("surrogate", T.StringType())]))


def pseudonymised(docs, key, id_col="doc_id", text_col="text", spans_col="entities"):
    """``docs`` with the entities of the text replaced, and their spans in ``spans_col``.

    ``key`` is secret bytes: equal keys give equal surrogates in every run over the same
    corpus. Within a corpus two entities of a kind never get one surrogate, none equals a
    real entity, and all spellings of an entity that are found get the same (names in lower case are not found). Parts of
    names count as one kind. Ids may be of any type, texts of any length. Spans count code points of the
    input and hold no original. A null text stays null and has no spans; texts without
    entities stay byte for byte; repeated rows are treated alike; an empty table gives
    an empty one; other columns pass through, one named ``spans_col`` is replaced.

    Draws after the first are few. They are sent out where their size, which is checked,
    is small, and joined to the documents that need them otherwise.
    """
    spark = docs.sparkSession
    later = redrawn(stored(entities(docs, text_col), "entities"), key)
    rest = [c for c in docs.columns if c != spans_col]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest])
    sent, joined = {}, False
    if later is not None:
        size = later.agg(F.sum(F.length("value") + 40)).first()[0] or 0
        if size <= MAX_BROADCAST_BYTES:
            sent = {(r["kind"], r["value"]): r["draw"] for r in later.collect()}
        else:
            name = next(n for n in (f"__row{k}" for k in range(len(rest) + 1)) if n not in rest)
            own = _draws_by_document(docs, later, id_col, text_col).withColumnRenamed("row", name)
            rows, joined = rows.join(own, _row_key(rows, id_col, text_col) == own[name], "left").drop(own[name]), True
    draws = spark.sparkContext.broadcast(sent)
    at = rest.index(text_col)
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(spans_col, SPANS)])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("surrogate", pa.string())]))

    def run(batches):
        for b in batches:
            own = b.column(len(rest)).to_pylist() if joined else [None] * b.num_rows
            texts, spans = [], []
            for text, extra in zip(b.column(at).to_pylist(), own):
                here = {(x["kind"], x["value"]): x["draw"] for x in extra} if extra else draws.value
                new, found = replaced(text, key, here) if text is not None else (None, [])
                texts.append(new)
                spans.append([dict(zip(("start", "end", "kind", "surrogate"), s)) for s in found])
            columns = list(b.columns[:len(rest)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, span)], names=[*rest, spans_col])

    return rows.mapInArrow(run, schema)


def _row_key(docs, id_col, text_col):
    """Equal for rows with one id and one text, null ids included."""
    return F.struct(docs[id_col].isNull().alias("none"), docs[id_col].alias("id"), F.xxhash64(docs[text_col].cast("string")).alias("h"))


def _draws_by_document(docs, later, id_col, text_col):
    """Per id and text the draws of the entities that have one, at most as many as the text has entities."""
    keys = docs.select(_row_key(docs, id_col, text_col).alias("row"), docs[text_col].cast("string").alias("text"))

    def run(batches):
        for b in batches:
            hits = [(i, k, v) for i, t in enumerate(b.column(1).to_pylist()) for k, v in {(k, v) for _, _, k, v in mentions(t)}]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([i for i, _, _ in hits], pa.int64())), pa.array([k for _, k, _ in hits], pa.string()), pa.array([v for _, _, v in hits], pa.string())],
                names=["row", "kind", "value"])

    pairs = keys.mapInArrow(run, f"row {keys.schema['row'].dataType.simpleString()}, kind string, value string")
    return stored(pairs.distinct().join(later, ["kind", "value"]).groupBy("row").agg(F.collect_set(F.struct("kind", "value", "draw")).alias("__draws")), "draws")
