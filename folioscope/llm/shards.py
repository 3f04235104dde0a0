"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size. The
shards take turns claiming their next free slot until the table is full. A row's key is
hashed to a slot, so placing it takes constant time; when a shard goes, nearly all other
slots keep theirs.
"""

import hashlib

from pyspark.sql import functions as F

SLOTS = 65_537


def is_prime(n):
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def _number(*parts):
    return int.from_bytes(hashlib.md5("\x1f".join(map(str, parts)).encode()).digest()[:8], "big")


def fill(shards, slots=SLOTS, weights=None):
    """The table: place of a shard in ``shards`` for every slot.

    ``weights`` are whole numbers of claims per turn, 1 by default. The size must be prime, so
    that every step from 1 to ``slots`` - 1 visits all slots.
    """
    shards = list(shards)
    weights = [1] * len(shards) if weights is None else list(weights)
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be given and differ")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime of at least the number of shards")
    if len(weights) != len(shards) or any(w < 0 or w != int(w) for w in weights) or not sum(weights):
        raise ValueError("weights must be whole numbers, one per shard, not all 0")
    offset = [_number("offset", s) % slots for s in shards]
    step = [_number("step", s) % (slots - 1) + 1 for s in shards]
    table, free = [None] * slots, slots
    while True:
        for i, turns in enumerate(weights):
            for _ in range(int(turns)):
                at = offset[i]
                while table[at] is not None:
                    at = (at + step[i]) % slots
                table[at], offset[i] = i, (at + step[i]) % slots
                free -= 1
                if not free:
                    return table


def place(df, key_col, shards, slots=SLOTS, weights=None, shard_col="shard", slot_col="slot"):
    """``df`` with the slot and the shard of each row's key.

    The table is one binary constant of four bytes per slot, which Spark sends out once with
    the task; a row reads its four bytes. No shuffle, no Python. Equal keys get equal
    shards; null is a key like any other, and an empty key another. Existing columns named
    ``shard_col`` or ``slot_col`` are replaced.
    """
    shards = list(shards)
    table = b"".join(i.to_bytes(4, "big") for i in fill(shards, slots, weights))
    key = F.coalesce(F.concat(F.lit("k"), F.col(f"`{key_col}`").cast("string")), F.lit("null"))
    slot = F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint") % slots
    out = df.withColumn(slot_col, slot)
    entry = F.substring(F.lit(table), (F.col(slot_col) * 4 + 1).cast("int"), F.lit(4))
    found = F.conv(F.hex(entry), 16, 10).cast("int")
    return out.withColumn(shard_col, F.element_at(F.array(*[F.lit(s) for s in shards]), found + 1))


def write(df, path, shard_col="shard", files_per_shard=1):
    """The rows as Parquet, one folder per shard. Each shard's rows are spread over
    ``files_per_shard`` tasks by a salt, so a shard is not bound to one task."""
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files_per_shard))
    df.repartition(F.col(shard_col), salt).write.partitionBy(shard_col).parquet(path)
