"""Descriptive statistics of the corpus."""

import math

from pyspark.sql import DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..session import stored

QUARTILES = (0.25, 0.5, 0.75)


def lengths(clean: DataFrame) -> DataFrame:
    """Description length, keyword count and embedding text length as columns."""
    out = clean.withColumn("desc_len", F.length("description_llm")).withColumn(
        "kw_count", X.keyword_count("keywords_llm")
    )
    if "text_for_embedding" in clean.columns:
        out = out.withColumn("embed_len", F.length("text_for_embedding"))
    return out


BRACKETS = 1024  # ranges of values per column and round
FEW = 4096  # distinct values of a range that are looked at one by one


def describe(df: DataFrame, columns) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per column; values that are no finite numbers are left out.

    One pass over ``df`` turns the columns into value frequencies; all else comes from these. The deviation
    is summed around the mean, which keeps a small spread of large values. A quartile's rank is
    bracketed by counts of a thousand ranges, which are summed up within tasks, then by ranges of that
    range, until so few values are left that they can be told one by one. Nothing is sorted, and no column's values meet in one task.
    """
    value = F.col("value")
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ])
    rows = df.select(F.inline(pairs)).filter(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    frequencies = stored(rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), "frequencies")
    # one row per column
    ends = {r["column"]: r for r in frequencies.groupBy("column").agg(
        F.sum("n").alias("count"), F.min("value").alias("min"), F.max("value").alias("max")).collect()}
    if not ends:
        return df.sparkSession.createDataFrame([], _DESCRIBED)
    low = _by_column({c: r["min"] for c, r in ends.items()})
    shifted = {r["column"]: r["s"] for r in frequencies.groupBy("column").agg(F.sum(F.col("n") * (value - low)).alias("s")).collect()}
    means = {c: r["min"] + shifted[c] / r["count"] for c, r in ends.items()}
    squares = {r["column"]: r["s"] for r in frequencies.groupBy("column").agg(
        F.sum(F.col("n") * (value - _by_column(means)) * (value - _by_column(means))).alias("s")).collect()}
    places = {c: sorted({f((r["count"] - 1) * q) for q in QUARTILES for f in (math.floor, math.ceil)}) for c, r in ends.items()}
    at = _values_at(frequencies, {c: (r["min"], r["max"]) for c, r in ends.items()}, places)

    def quartile(c, q):
        place = (ends[c]["count"] - 1) * q
        a, b = at[c, math.floor(place)], at[c, math.ceil(place)]
        return a + (b - a) * (place - math.floor(place))

    out = [(c, r["count"], means[c], math.sqrt(squares[c] / (r["count"] - 1)) if r["count"] > 1 else None, r["min"],
            *[quartile(c, q) for q in QUARTILES], r["max"]) for c, r in ends.items()]
    return df.sparkSession.createDataFrame(out, _DESCRIBED)


_DESCRIBED = "column string, count long, mean double, std double, min double, " + ", ".join(f"p{int(q * 100)} double" for q in QUARTILES) + ", max double"


def _by_column(values):
    """The number of a row's column."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("column"))


def _values_at(frequencies, ranges, places):
    """{(column, place): value}: the values at some places, from 0, of each column's sorted rows.

    ``ranges``: the smallest and largest value per column. A round looks into the ranges that still hold a wanted place, at most six per column.
    """
    found, todo = {}, [(c, lo, hi, 0, list(places[c])) for c, (lo, hi) in ranges.items()]
    while todo:
        spark = frequencies.sparkSession
        asked = spark.createDataFrame([(c, float(lo), float(hi), i) for i, (c, lo, hi, _, _) in enumerate(todo)], "column string, lo double, hi double, part int")
        inside = frequencies.join(F.broadcast(asked), "column").filter((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))
        half = F.lit(0.5)  # of either end, since their distance may be no double
        share = F.try_divide(F.col("value") * half - F.col("lo") * half, F.col("hi") * half - F.col("lo") * half)
        bracket = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BRACKETS), F.lit(BRACKETS - 1)).cast("int")
        sums = inside.groupBy("part", bracket.alias("bracket")).agg(
            F.sum("n").alias("rows"), F.count("*").alias("values"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        by_part = {}
        for r in sums.collect():  # at most BRACKETS per range
            by_part.setdefault(r["part"], []).append(r)
        narrower, few = [], []
        for i, (c, _, _, before, wanted) in enumerate(todo):
            for r in sorted(by_part[i], key=lambda r: r["lo"]):
                mine = [p for p in wanted if before <= p < before + r["rows"]]
                if mine and r["lo"] == r["hi"]:
                    found.update({(c, p): r["lo"] for p in mine})
                elif mine:
                    (few if r["values"] <= FEW else narrower).append((c, r["lo"], r["hi"], before, mine))
                before += r["rows"]
        if few:
            asked = spark.createDataFrame([(c, float(lo), float(hi), i) for i, (c, lo, hi, _, _) in enumerate(few)], "column string, lo double, hi double, part int")
            rows = frequencies.join(F.broadcast(asked), "column").filter((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))).select("part", "value", "n").collect()
            for i, (c, _, _, before, wanted) in enumerate(few):
                for r in sorted((r for r in rows if r["part"] == i), key=lambda r: r["value"]):
                    found.update({(c, p): r["value"] for p in wanted if before <= p < before + r["n"]})
                    before += r["n"]
        todo = narrower
    return found


def page_count(clean: DataFrame) -> DataFrame:
    return clean.agg(F.max("page").alias("pages"))


def items_per_page(clean: DataFrame) -> DataFrame:
    return clean.filter(F.col("page").isNotNull()).groupBy("page").agg(F.count(F.lit(1)).alias("items"))


def items_per_page_stats(clean: DataFrame) -> DataFrame:
    return describe(items_per_page(clean), ["items"])


def mean_length_by_type(clean: DataFrame) -> DataFrame:
    return lengths(clean).groupBy("type").agg(F.avg("desc_len").alias("mean_desc_len"))


def count_by_type(clean: DataFrame) -> DataFrame:
    return clean.groupBy("type").agg(F.count(F.lit(1)).alias("items"))


def column_overview(df: DataFrame) -> DataFrame:
    """Non-null values per column, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in df.columns])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("non_null"), F.col("_rows").alias("rows"))
        for c in df.columns
    ])
    return counts.select(F.inline(rows))


def first_rows(df: DataFrame, order, n=5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def table_counts(**tables) -> DataFrame:
    """Row count per named table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def histogram(df: DataFrame, column, bins) -> DataFrame:
    """Equal-width bins from the smallest to the largest value, empty bins included.

    The last bin includes its upper edge. Where all values are equal the range is widened
    by half a unit on either side. Rows shrink to a table of value frequencies first, from which
    the bounds come, too: the input is scanned once.
    """
    values = df.select(F.col(column).cast("double").alias("value")).filter(F.col("value").isNotNull())
    frequencies = stored(values.groupBy("value").agg(F.count(F.lit(1)).alias("n")), "frequencies")
    low, high = F.min("value"), F.max("value")
    margin = F.when(low == high, 0.5).otherwise(0.0)
    bounds = frequencies.agg(
        F.struct((low - margin).alias("lo"), (high + margin).alias("hi")).alias("b")
    ).scalar()
    lo, hi = F.col("b.lo"), F.col("b.hi")
    place = F.least(F.floor((F.col("value") - lo) * bins / (hi - lo)), F.lit(bins - 1))
    counted = (
        frequencies.withColumn("b", bounds)
        .groupBy(place.cast("int").alias("bin")).agg(F.sum("n").alias("n"))
    )
    width = (hi - lo) / bins
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("b", bounds)
    return all_bins.join(counted, "bin", "left").select(
        "bin",
        (lo + F.col("bin") * width).alias("lower"),
        (lo + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("items"),
    )


def top_pages(clean: DataFrame, n=V.TOP_PAGES) -> DataFrame:
    return items_per_page(clean).orderBy(F.desc("items"), F.asc("page")).limit(n)


def _kept_words(words, stop):
    """Words without stop words."""
    return F.filter(words, lambda w: ~w.isin(stop))


BUCKETS = 1 << 16


def _frequent(grams: DataFrame, columns, n) -> DataFrame:
    """The ``n`` most frequent combinations of ``columns`` (a null ends one) with their count, as (gram, items), exactly.

    First the rows are only counted by hash, in 65,536 buckets: what is shuffled does not grow with the vocabulary.
    No member of a bucket is more frequent than the bucket. Then the members of the fullest buckets are counted by name. If the n-th of these
    is more frequent than every other bucket the list is proven, else the buckets that could hold a better one are counted, too.
    """
    bucket = F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")
    sizes = {r[0]: r[1] for r in grams.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).collect()}
    order = sorted(sizes, key=lambda b: -sizes[b])
    take = min(len(order), 4 * n)
    while True:
        some = grams.filter(bucket.isin(order[:take])) if take < len(order) else grams
        named = some.groupBy(F.concat_ws(" ", *columns).alias("gram")).agg(F.count("*").alias("items"))
        top = stored(named.orderBy(F.desc("items"), F.asc("gram")).limit(n), "top")
        last = top.agg(F.count("*").alias("n"), F.min("items").alias("items")).first()
        least = last["items"] if last["n"] == n else 0
        if take == len(order) or sizes[order[take]] < least:
            return top
        while take < len(order) and sizes[order[take]] >= least:
            take += 1


def word_frequency(clean: DataFrame, text="description_llm", stop=None, n=V.TOP_WORDS) -> DataFrame:
    """The most frequent words without stop words, with weight relative to the first."""
    stop = X.stop_words() if stop is None else list(stop)
    # the outer form keeps the optimizer from cutting the words a second time to test their number
    words = clean.select(F.explode_outer(X.tokens(F.col(text))).alias("word")).filter(F.col("word").isNotNull() & ~F.col("word").isin(stop))
    top = _frequent(words, ["word"], n).withColumnRenamed("gram", "word")
    # the window covers the n rows of the list, nothing more
    return top.withColumn("weight", F.col("items") / F.max("items").over(Window.partitionBy()))


def top_ngrams(clean: DataFrame, text="description_llm", sizes=(2, 2), stop=None,
               n=V.TOP_NGRAMS) -> DataFrame:
    """The most frequent n-grams. Stop words go first, so an n-gram may span one; it
    never spans two texts."""
    stop = X.stop_words() if stop is None else list(stop)
    longest = sizes[1]
    words = clean.select(_kept_words(X.tokens(F.col(text)), stop).alias("words"))
    names = [f"w{i}" for i in range(longest)]
    # every word with its successors; a null where the text ends
    runs = F.arrays_zip(*[F.slice("words", i + 1, F.greatest(F.size("words"), F.lit(1))).alias(name) for i, name in enumerate(names)])
    runs = words.select(F.explode_outer(runs).alias("r")).filter(F.col("r").isNotNull()).select("r.*")
    if sizes[0] < longest:
        cut = [F.struct(*[F.when(F.lit(j < size), F.col(w)).alias(w) for j, w in enumerate(names)]) for size in range(sizes[0], longest + 1)]
        ends = [F.col(names[size - 1]).isNotNull() for size in range(sizes[0], longest + 1)]
        each = F.array(*[F.when(end, c) for end, c in zip(ends, cut)])
        grams = runs.select(F.explode(each).alias("g")).filter(F.col("g").isNotNull()).select("g.*")
    else:
        grams = runs.filter(F.col(names[-1]).isNotNull())
    return _frequent(grams, names, n).withColumnRenamed("gram", "ngram")
