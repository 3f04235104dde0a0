"""Benchmark passages inside documents, by a prefix-filtered set join. Native expressions only.

An item gives windows of ten consecutive words (a shorter item is one window). Every
window is a set of two-word shingles that a document must hold in full, so its prefix is
a single shingle, and the rarest in the corpus is the cheapest one. Documents
join these few shingles; places where a window would not fit are passed over, and the
others are compared word by word with the window.
"""

from pyspark.sql import functions as F, types as T

from .shared import stored

WINDOW = 10
SENT_BYTES = 16 << 20  # prefixes sent out to all tasks; more are joined by a shuffle
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: what separates words before A-Z are lower-cased, and the words themselves
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text):
    """The words as they are written; null for null."""
    return F.array_remove(F.split(text, BREAK), "")


def low(word):
    """A-Z lower-cased, nothing else."""
    return F.translate(word, UPPER, LOWER)


def windows(items, id_col="item_id", text_col="text", width=WINDOW):
    """(window, size, items): the distinct windows, as arrays of lower-cased words."""
    word = F.transform(words(items[text_col].cast("string")), low)
    rows = items.select(items[id_col].cast("string").alias("item"), word.alias("words")).where(F.size("words") > 0)
    first = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0))))
    rows = rows.withColumn("at", first).select("item", F.slice("words", F.col("at") + 1, F.lit(width)).alias("window"))
    return rows.groupBy("window").agg(F.collect_set("item").alias("items")).select("window", F.size("window").alias("size"), "items")


def _pairs(docs):
    """(i, h, n, at, one, two): every word of a document with its successor.

    ``one`` and ``two`` are in the lower case of all scripts: words that are equal with A-Z lower-cased
    are equal so, and it costs far less; the comparison of whole windows is exact.
    The outer form with a null test keeps Spark from cutting the words twice.
    """
    cut = docs.select("i", "h", words(F.col("text")).alias("words"))
    cut = cut.select("i", "h", F.size("words").alias("n"),
                     F.posexplode_outer(F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("b"))).alias("at", "s"))
    return cut.where("s IS NOT NULL AND s.a IS NOT NULL").select(
        "i", "h", "n", "at", F.lower("s.a").alias("one"), F.lower("s.b").alias("two"))


def _prefixes(wins, docs):
    """(one, two, window, size, items, skip): the rarest shingle of every window.

    The shingles of the windows are counted in all documents. A window of one word has its
    word and null as its shingle, which then fits any successor.
    """
    n = F.size("window")
    shingles = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda k: F.struct(
        k.alias("skip"), F.lower(F.get("window", k)).alias("one"), F.lower(F.get("window", k + 1)).alias("two")))
    each = wins.select("window", "size", "items", F.explode(shingles).alias("s")).select("window", "size", "items", "s.*")
    asked = stored(each.select(F.col("one").alias("o"), F.col("two").alias("t")).distinct(), "asked")
    counts = (_pairs(docs).join(asked, (F.col("one") == F.col("o")) & (F.col("t").isNull() | (F.col("two") == F.col("t"))))
              .groupBy("o", "t").agg(F.count("*").alias("seen")))
    rank = F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "one", "two", "skip")
    return (each.join(counts, (F.col("one") == F.col("o")) & F.col("two").eqNullSafe(F.col("t")), "left")
            .groupBy("window", "size", "items").agg(F.min(rank).alias("r"))
            .select(F.col("r.one").alias("one"), F.col("r.two").alias("two"), "window", "size", "items", F.col("r.skip").alias("skip")))


def _key(docs, id_col, text_col):
    """Columns that are never null and differ where id or text differ. Ids that are no whole numbers count by their hash."""
    id_, text = docs[id_col], docs[text_col].cast("string")
    number = id_.cast("long") if isinstance(docs.schema[id_col].dataType, T.IntegralType) else F.xxhash64(id_)
    return F.coalesce(number, F.lit(0).cast("long")), F.xxhash64(id_.isNull(), text)


def keyed(docs, id_col, text_col):
    i, h = _key(docs, id_col, text_col)
    return docs.select(i.alias("i"), h.alias("h"), docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))


def _found_at_once(rows, prefixes):
    """(i, h, id, n, copies, found): the occurring windows of each row, told where its words are cut; no text is moved.

    Each row gives one marker, an element without words, and one element per word. Elements meet the prefixes, which are
    sent out, and a window that fits is compared as text: its words hold no blank.
    """
    cut = rows.select("i", "h", "id", words(F.col("text")).alias("words"))
    pairs = F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("b"))
    none = F.array(F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")))
    cut = cut.select("i", "h", "id", "words", F.greatest(F.coalesce(F.size("words"), F.lit(0)), F.lit(0)).alias("n"),
                     F.posexplode(F.concat(none, F.coalesce(pairs, none))).alias("at", "s"))
    cut = cut.where("at = 0 OR s.a IS NOT NULL").select("i", "h", "id", "words", "n", (F.col("at") - 1).alias("at"), F.lower("s.a").alias("one"), F.lower("s.b").alias("two"))
    p = prefixes.select(F.col("one").alias("o"), F.col("two").alias("t"), F.concat_ws(" ", "window").alias("said"), "size", "items", "skip")
    start = F.col("at") - F.col("skip")
    same = low(F.concat_ws(" ", F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("size")))) == F.col("said")
    met = cut.join(F.broadcast(p), (F.col("one") == F.col("o")) & (F.col("t").isNull() | (F.col("two") == F.col("t"))), "left")
    met = met.where((F.col("at") == -1) | F.col("said").isNotNull() & (start >= 0) & (start + F.col("size") <= F.col("n")) & same)
    hit = F.when(F.col("at") >= 0, F.struct(start.alias("start"), F.col("size"), F.col("items")))
    return met.groupBy("i", "h").agg(
        F.first("id", ignorenulls=True).alias("id"), F.max("n").alias("n"), F.count_if(F.col("at") == -1).alias("copies"), F.collect_set(hit).alias("found"))


def _found_by_join(rows, prefixes):
    """The same for prefixes of any number: documents join them by a shuffle, and texts with candidates are read again."""
    p = prefixes.select(F.col("one").alias("o"), F.col("two").alias("t"), "window", "size", "items", "skip")
    start = F.col("at") - F.col("skip")
    fits = (start >= 0) & (start + F.col("size") <= F.col("n"))
    near = (_pairs(rows).join(p, (F.col("one") == F.col("o")) & (F.col("t").isNull() | (F.col("two") == F.col("t"))))
            .where(fits).select("i", "h", start.alias("start"), "window", "items"))
    near = stored(near, "near").groupBy("i", "h").agg(F.collect_set(F.struct("start", "window", "items")).alias("near"))

    def same(cut):
        return lambda c: F.transform(F.slice(cut, c["start"] + 1, F.size(c["window"])), low) == c["window"]

    # one array element binds the words, which would else be cut again for every candidate
    found = F.get(F.transform(F.array(words(F.col("text"))), lambda cut: F.filter("near", same(cut))), 0)
    found = F.transform(F.when(F.col("near").isNotNull(), found), lambda c: F.struct(c["start"].alias("start"), F.size(c["window"]).alias("size"), c["items"].alias("items")))
    return rows.join(near, ["i", "h"], "left").select(
        "i", "h", "id", F.greatest(F.coalesce(F.size(words(F.col("text"))), F.lit(0)), F.lit(0)).alias("n"), F.lit(1).cast("long").alias("copies"), found.alias("found"))


def _judged(docs, items, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", width=WINDOW, sent_bytes=SENT_BYTES):
    """``hits`` with the key (i, h) of each row, and the id as ``id``."""
    rows = keyed(docs, id_col, text_col)
    wins = windows(items, item_col, item_text_col, width)
    prefixes = stored(_prefixes(stored(wins, "windows"), rows), "prefixes")
    size = prefixes.agg(F.sum(F.length(F.to_json(F.struct("window", "items"))) + 100).alias("n")).first()["n"] or 0
    found = _found_at_once(rows, prefixes) if size <= sent_bytes else _found_by_join(rows, prefixes)
    places = F.flatten(F.transform("found", lambda c: F.sequence(c["start"], c["start"] + c["size"] - 1)))
    listed = F.sort_array(F.array_distinct(F.flatten(F.transform("found", lambda c: c["items"]))))
    out = found.select("i", "h", "id", F.col("n").cast("long").alias("n_words"), "copies",
                       F.greatest(F.coalesce(F.size(F.array_distinct(places)), F.lit(0)), F.lit(0)).cast("long").alias("n_hit"),
                       F.coalesce(listed, F.array().cast("array<string>")).alias("items"))
    # rows that are equal in id and text were told as one
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select("i", "h", "id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def hits(docs, items, id_col="doc_id", text_col="text", **more):
    """(id, n_words, n_hit, n_items, items, contaminated) of each row of ``docs``.

    A word inside any occurrence of a window is hit; ``items`` are the ids of the items with
    an occurring window, as sorted strings. Null, empty and wordless texts have no words and
    no hits; null and wordless items have no windows, and an item whose id is null hits words
    without being listed. Repeated rows of either table are judged alike and count once per
    row or id. Ids may be of any simple type; texts of any length are judged whole. Empty tables give no rows, or rows without hits. Other columns are not read.
    """
    return _judged(docs, items, id_col, text_col, **more).drop("i", "h").withColumnRenamed("id", id_col)


def clean(docs, items, id_col="doc_id", text_col="text", **more):
    """The rows of ``docs`` without any hit, all columns as they were.

    A row is judged by its own text: rows that repeat an id with another text, and rows
    with a null id, go or stay one by one.
    """
    bad = _judged(docs, items, id_col, text_col, **more).where("contaminated").select(F.struct("i", "h").alias("key")).distinct()
    i, h = _key(docs, id_col, text_col)
    free = next(n for n in (f"__bad{k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    bad = stored(bad.withColumnRenamed("key", free), "contaminated")
    return docs.join(bad, (i == bad[free]["i"]) & (h == bad[free]["h"]), "left_anti")
