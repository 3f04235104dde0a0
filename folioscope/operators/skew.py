"""Joins in which a few keys of one side hold a large share of its rows.

The keys are counted by hash in a fixed number of buckets, a pass over the key columns alone. Rows of buckets that hold too
many do not go through the shuffle: what they meet on the other side is sent to them where it is small, by a
checked count, and repeated under salts where it is not. All other rows join as usual.
"""

from pyspark.sql import DataFrame, functions as F

BUCKETS = 1 << 16
SHARE = 1 / 256  # of all rows; a bucket beyond this is heavy
LEAST = 10_000  # rows that any task can take
SENT_ROWS = 100_000
SALTS = 64


def _bucket(keys):
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def heavy(rows: DataFrame, keys, share=SHARE, least=LEAST):
    """The buckets of ``keys`` with more than their share of rows, at most 1 / ``share``."""
    counts = {r[0]: r[1] for r in rows.groupBy(_bucket(keys)).agg(F.count(F.lit(1))).collect()}  # at most BUCKETS
    limit = max(sum(counts.values()) * share, least)
    return sorted(b for b, n in counts.items() if n > limit)


def join(left: DataFrame, right: DataFrame, keys, how="inner", share=SHARE, least=LEAST, sent_rows=SENT_ROWS) -> DataFrame:
    """``left.join(right, keys, how)`` for a ``left`` with hot keys; ``how`` is inner, left, left_semi or left_anti.

    Key columns have the same types on both sides. ``left`` is read three times, give a table.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"rows of the right side would repeat in a {how} join")
    keys = list(keys)
    hot = heavy(left, keys, share, least)
    if not hot:
        return left.join(right, keys, how)
    is_hot = _bucket(keys).isin(hot)
    rest = left.filter(~is_hot).join(right, keys, how)
    few = right.filter(is_hot)
    if few.limit(sent_rows + 1).count() <= sent_rows:
        return rest.unionByName(left.filter(is_hot).join(F.broadcast(few), keys, how))
    salt = next(n for n in (f"_salt{k}" for k in range(len(left.columns) + len(right.columns) + 1)) if n not in [*left.columns, *right.columns])
    salted = left.filter(is_hot).withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    copies = few.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rest.unionByName(salted.join(copies, [*keys, salt], how).drop(salt))
