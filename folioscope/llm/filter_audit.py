"""How filters interact: what each removes in every order, by a recursive CTE over filter prefixes.

Every document becomes a mask, one bit per filter that it fails. Documents of one part and
one mask are one cell, and a part has at most 2**n cells, whatever the size of the corpus.
The recursion starts at the empty prefix of every part, extends it with each letter not
yet used, meets the part's cells, and carries the bits applied so far; a level emits the figures of
its step. Orders that begin alike share their prefix, so n letters cost no more than e * n! prefixes a part.
"""

import itertools

from pyspark.sql import functions as F

from .shared import stored

BREAK = r"[\x20\x09-\x0D]+"
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

_RECURSION = """
WITH RECURSIVE walk(part, prefix, step, applied, found) AS (
    SELECT part, CAST('' AS STRING), 0, 0,
           CAST(NULL AS STRUCT<kept: BIGINT, removed: BIGINT, redundant: BIGINT, unique_fails: BIGINT, good_lost: BIGINT, toxic_lost: BIGINT>)
    FROM {parts}
    UNION ALL
    SELECT part, concat(prefix, letter), step + 1, applied | bit,
           aggregate(cells,
               named_struct('kept', 0L, 'removed', 0L, 'redundant', 0L, 'unique_fails', 0L, 'good_lost', 0L, 'toxic_lost', 0L),
               (s, c) -> named_struct(
                   'kept', s.kept + IF(c.mask & (applied | bit) = 0, c.n, 0L),
                   'removed', s.removed + IF(c.mask & applied = 0 AND c.mask & bit <> 0, c.n, 0L),
                   'redundant', s.redundant + IF(c.mask & applied <> 0 AND c.mask & bit <> 0, c.n, 0L),
                   'unique_fails', s.unique_fails + IF(c.mask = bit, c.n, 0L),
                   'good_lost', s.good_lost + IF(c.mask & applied = 0 AND c.mask & bit <> 0, c.good, 0L),
                   'toxic_lost', s.toxic_lost + IF(c.mask & applied = 0 AND c.mask & bit <> 0, c.toxic, 0L)))
    FROM (SELECT w.part, w.prefix, w.step, w.applied, c.cells,
                 explode(filter({letters}, f -> w.applied & f.bit = 0)) AS f
          FROM walk w JOIN {parts} c ON c.part = w.part)
         LATERAL VIEW inline(array(f)) AS letter, bit
)
SELECT part, prefix, step, found.* FROM walk WHERE step > 0
"""


def failures(text):
    """Letter to failure condition of the five filters, for a text that is not null.

    A: under 200 words. B: under half of the words are distinct. C: over 3 % of the code points are
    A-Z. D: holds one of # $ % & * |. The fifth, E, asks for other rows: see ``cells``.
    """
    words = F.array_remove(F.split(text, BREAK), "")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def cells(docs, labels, id_col="doc_id", text_col="text", part_col="lang"):
    """(part, mask, n, good, toxic): documents by part and failed filters A to E (bits 1, 2, 4, 8, 16).

    E: the text equals that of a row with a smaller id, whatever its part. A null text is
    empty, a null part the empty string. A row with a null id has no smaller one and no label, and
    makes no other row fail. Repeated rows count each; rows with one id share its labels, and
    an id is good or toxic if any of its label rows says so. Columns not named here are not read.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    mask = sum((F.when(bad, 1 << k).otherwise(0) for k, bad in enumerate(failures(F.col("text")).values())), F.lit(0))
    rows = rows.select("id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("same"))
    marks = (labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").cast(docs.schema[id_col].dataType).alias("id"))
             .agg(F.max(F.expr("coalesce(quality = 1, false)")).alias("good"), F.max(F.expr("coalesce(toxic = 1, false)")).alias("toxic"))
             .withColumn("salt", F.lit(0).cast("long")))
    # null ids meet no label and are spread out; a table on the other side lets Spark split a hot id
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.monotonically_increasing_id()).otherwise(0))
    rows = rows.join(stored(marks, "marks"), ["id", "salt"], "left").select(
        "same", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "id")
    # copies become one row before anything is sorted by text: (smallest id, rows that have it, other rows)
    alike = ["same", "part", "mask", "good", "toxic"]
    rows = rows.groupBy(*alike, F.struct("id").alias("own")).agg(F.count("*").alias("n"))
    rows = rows.groupBy(*alike).agg(
        F.min(F.when(F.col("own.id").isNotNull(), F.struct(F.col("own.id").alias("id"), "n"))).alias("first"),
        F.sum("n").alias("n"), F.sum(F.when(F.col("own.id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    rows = stored(rows, "alike")
    least = rows.groupBy("same").agg(F.min("first.id").alias("least"), F.count("*").alias("kinds"))
    # only texts that stand in several parts or under several labels need the least id of them all
    wide = stored(least.where("kinds > 1").select("same", "least"), "wide")
    rows = rows.join(wide, "same", "left")
    holds = F.col("least").isNull() | (F.col("first.id") == F.col("least"))
    fresh = F.col("nameless") + F.when(F.col("first").isNotNull() & holds, F.col("first.n")).otherwise(0)
    # (rows that pass E, rows that fail it)
    both = F.explode(F.array(F.struct(F.lit(0).alias("bit"), fresh.alias("n")), F.struct(F.lit(16).alias("bit"), (F.col("n") - fresh).alias("n"))))
    return (rows.select("part", "mask", "good", "toxic", both.alias("e")).where("e.n > 0")
            .groupBy("part", (F.col("mask") + F.col("e.bit")).alias("mask"))
            .agg(F.sum("e.n").alias("n"), F.sum(F.expr("IF(good, e.n, 0L)")).alias("good"), F.sum(F.expr("IF(toxic, e.n, 0L)")).alias("toxic")))


def audit(cells, letters="ABCDE"):
    """(part, filter_order, step, figures, shapley): every order of the filters, step by step.

    ``cells`` has one row (part, mask, n, good, toxic) per part and mask; bit k of the mask is the k-th
    of ``letters``. Parts without cells have no rows, and no cells give none.
    """
    spark = cells.sparkSession
    parts = stored(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), "parts")
    bits = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << k})" for k, x in enumerate(letters))
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")  # rows follow the number of parts; the depth is that of the letters
    try:
        walk = stored(spark.sql(_RECURSION.replace("{letters}", f"array({bits})"), parts=parts), "walk")
    finally:
        spark.conf.set(name, before)
    orders = [(o[:k], o, k) for o in map("".join, itertools.permutations(letters)) for k in range(1, len(letters) + 1)]
    steps = F.broadcast(spark.createDataFrame(orders, "prefix string, filter_order string, step int"))  # n * n! rows
    rows = stored(walk.drop("step").join(steps, "prefix").select("part", "filter_order", "step", F.right("prefix", F.lit(1)).alias("letter"), *FIGURES), "steps")
    shapley = rows.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return rows.join(shapley, ["part", "letter"]).select("part", "filter_order", "step", *FIGURES, "shapley")
