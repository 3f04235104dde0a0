"""Which annotations exist, answered without opening them: Bloom filters of the keys.

A key is a document and an id. Keys fall into 256 parts by document and range of pages, which are also the
folders of the store. The filter of a part is a number of bitmaps of 32,768 bits, a power of two, by its keys; a key
sets eight bits of one bitmap. Filters of one part are merged by their bits, a smaller one being repeated first, so each
append writes only a filter of its own keys, before its rows become part of the store.
"""

from pyspark.sql import DataFrame, functions as F

from ..session import stored

PARTS = 256
PAGES = 64  # pages of a document that share a part
BITMAP = 32_768
BITS_PER_KEY = 20  # one key in 7,000 that does not exist looks as if it did
SCHEMA = "part int, size int, place int, bits binary"


def part(doc_id="doc_id", page="page"):
    """The part of a key; rows without a page share those of page 0."""
    pages = F.floor(F.coalesce(F.col(page).cast("long"), F.lit(0)) / PAGES)
    return F.pmod(F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), pages), F.lit(PARTS)).cast("int")


def _hashed(keys):
    """(part, h, positions): ``h`` chooses the bitmap, ``positions`` are bits in it."""
    key = [F.col("doc_id").cast("string").isNull(), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("id")]
    words = [F.xxhash64(F.lit(salt), *key) for salt in (1, 2)]
    positions = F.array(*[F.shiftright(w, 15 * i).bitwiseAND(F.lit(BITMAP - 1)) for w in words for i in range(4)])
    return keys.select(part().alias("part"), F.xxhash64(*key).alias("h"), positions.alias("positions"))


def write(rows: DataFrame, path):
    """The filter of the keys (doc_id, id, page) of ``rows``."""
    keys = stored(_hashed(rows), "keys")
    # at most one row per part
    sizes = keys.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("n") * BITS_PER_KEY / BITMAP, F.lit(1.0))))).cast("int").alias("size"))
    placed = keys.join(F.broadcast(sizes), "part").select("part", "size", F.pmod("h", "size").cast("int").alias("place"), F.explode("positions").alias("bit"))
    placed.groupBy("part", "size", "place").agg(F.bitmap_construct_agg("bit").alias("bits")).write.parquet(path)


def merged(filters: DataFrame) -> DataFrame:
    """One filter per part, as large as its largest."""
    sizes = filters.groupBy("part").agg(F.max("size").alias("full"))  # at most one row per part
    copies = F.explode(F.sequence(F.col("place"), F.col("full") - 1, F.col("size")))
    wide = filters.join(F.broadcast(sizes), "part").select("part", F.col("full").alias("size"), copies.alias("place"), "bits")
    return wide.groupBy("part", "size", "place").agg(F.bitmap_or_agg("bits").alias("bits"))


def _is_set(bits, position):
    """Is a bit of a bitmap set?"""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def parts_to_open(candidates: DataFrame, filters: DataFrame):
    """The parts in which a candidate (doc_id, id, page) may already exist, at most 256."""
    keys = stored(_hashed(candidates), "keys")
    asked = [r[0] for r in keys.select("part").distinct().collect()]
    filters = stored(merged(filters.filter(F.col("part").isin(asked))), "filters")
    sizes = filters.select("part", "size").distinct()
    placed = keys.join(F.broadcast(sizes), "part").withColumn("place", F.pmod("h", "size").cast("int"))
    met = placed.join(filters.drop("size"), ["part", "place"])
    return sorted(r[0] for r in met.filter(F.forall("positions", lambda p: _is_set(F.col("bits"), p))).select("part").distinct().collect())
