"""A cache of encoder outputs, addressed by model and input.

A rebuild encodes only inputs that no build has encoded before. The key of an input is the hash of its
model, its kind and its bytes, so equal inputs of a build, of several approaches or of several builds
are one key. Only keys are compared with the cache; the inputs themselves stay where they are.
A vector of zeros may stand for a failed encode and is not kept: the next build asks again.
"""

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import vectors as U
from ..operators import embedtext as E
from ..session import stored
from ..sources import versions
from .approaches import Inputs

SCHEMA = T.StructType([
    T.StructField("key", T.BinaryType()), T.StructField("model", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("run", T.StringType())])
SENT_BITMAPS = 1 << 12  # up to so many bitmaps of 4 KB are sent to the tasks, for some 33 million rows of 4 inputs; more are joined by a shuffle


def key(model, kind, width, source):
    """32 bytes for an input; null for null."""
    head = F.encode(F.lit(f"{model}\0{kind}\0{width}\0"), "UTF-8")
    return F.unhex(F.sha2(F.concat(head, source.cast("binary")), 256))


class Cache:
    """The cache at ``path``. What a build adds is marked with its ``run`` key; a build that is
    repeated under its key after a crash goes on where it ended."""

    def __init__(self, spark, path, run):
        self.spark, self.path, self.run = spark, path, run

    def read(self) -> DataFrame:
        return versions.read(self.spark, self.path, SCHEMA)

    def encodes(self) -> DataFrame:
        """How many inputs each build has encoded with each model."""
        return self.read().groupBy("run", "model", "kind").agg(F.count("*").alias("encoded"))

    def inputs(self, encoders, content):
        return CachedInputs(self, encoders, content)

    def encode_new(self, rows, slots, encoders):
        """Encode the inputs of ``rows`` that the cache does not hold. ``slots``: name to (model, kind, input column).

        ``rows`` is a stored table with its rows' numbers and keys. An input is encoded in the first row that has it: only
        keys are shuffled, and a bitmap tells the tasks which inputs of their rows are asked.
        """
        step = 1 << (len(slots) - 1).bit_length()  # the bits of a row are in one bitmap
        places = {name: F.col("_row") * step + (n + 1) for n, name in enumerate(slots)}
        each = F.explode_outer(F.array(*[F.struct(F.col(_key(name)).alias("key"), place.alias("place")) for name, place in places.items()]))
        asked = rows.select(each.alias("a")).select("a.*").filter(F.col("key").isNotNull())
        new = asked.groupBy("key").agg(F.min("place").alias("place")).join(self.read().select("key"), "key", "left_anti")
        bits = new.groupBy(F.bitmap_bucket_number("place").alias("_bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("_bits"))
        bits = stored(bits, "new_inputs")
        small = bits.count() <= SENT_BITMAPS
        marked = rows.withColumn("_bucket", F.bitmap_bucket_number(next(iter(places.values())))).join(
            F.broadcast(bits) if small else bits, "_bucket")
        groups, done = {}, None
        for name, (model, kind, source) in slots.items():
            groups.setdefault((model, kind), []).append((_is_set("_bits", places[name]), F.col(_key(name)), source))
        for (model, kind), inputs in groups.items():
            each = F.explode_outer(F.array(*[F.struct(F.when(new, k).alias("key"), F.when(new, s).alias("input")) for new, k, s in inputs]))
            todo = marked.select(each.alias("a")).select("a.*").filter(F.col("key").isNotNull())
            encode = encoders[model].text if kind == "text" else encoders[model].image
            one = todo.select("key", encode(F.col("input")).alias("vector")).filter(F.exists("vector", lambda x: x != 0)).select(
                "key", F.lit(model).alias("model"), F.lit(kind).alias("kind"), F.col("vector").cast("array<float>").alias("vector"), F.lit(self.run).alias("run"))
            done = one if done is None else done.unionByName(one)
        versions.append(done, self.path)


def _key(name):
    return f"_key{name}"


def _is_set(bitmap, place):
    """Is the bit of ``place`` set in its bitmap?"""
    at = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, at % 8) == 1


class CachedInputs(Inputs):
    """Texts and vectors that approaches need, the vectors from the cache."""

    def __init__(self, cache, encoders, content):
        super().__init__(encoders, content)
        self.cache, self.slots = cache, {}

    def words(self, model, templates):
        text = self.text(templates)
        source = E.prefixed(text, self.encoders[model].passage_prefix)
        return self._name(("words", model, text), self.slots, lambda: (model, "text", source))

    def pixels(self, model):
        return self._name(("pixels", model), self.slots, lambda: (model, "image", F.col(self.content)))

    def add_to(self, df):
        if not self.slots:
            return df.withColumns(self.texts)
        keys = {_key(name): key(model, kind, self.encoders[model].width, source) for name, (model, kind, source) in self.slots.items()}
        # made once: all that follows reads columns of this table, in which a row keeps its number
        rows = df.withColumns(self.texts).withColumns(keys).drop(*self.texts).withColumn("_row", F.monotonically_increasing_id())
        rows = stored(rows, "rows", compression="zstd").withColumns(self.texts)
        self.cache.encode_new(rows, self.slots, self.encoders)
        # rows with the same inputs share their vectors, so what is joined is one row per set of inputs
        mark = F.substring(F.unhex(F.sha2(F.concat(*[F.coalesce(F.col(k), F.lit(b"-")) for k in keys]), 256)), 1, 16)
        each = F.explode_outer(F.array(*[F.struct(F.lit(n).alias("slot"), F.col(_key(name)).alias("key")) for n, name in enumerate(self.slots)]))
        wanted = rows.select(mark.alias("_mark"), *keys).distinct().select("_mark", each.alias("s")).select("_mark", "s.*").filter(F.col("key").isNotNull())
        # two builds at a time may have encoded an input twice: all rows get the same one of its vectors
        pivot = [F.max(F.when(F.col("slot") == n, F.col("vector"))).alias(name) for n, name in enumerate(self.slots)]
        found = wanted.join(self.cache.read().select("key", "vector"), "key").groupBy("_mark").agg(*pivot)
        found = stored(found, "vectors", compression="zstd")
        rows = rows.withColumn("_mark", mark).join(found, "_mark", "left").drop("_mark", "_row", *keys)
        return rows.withColumns({name: U.zero_if_missing(F.col(name), self.encoders[model].width) for name, (model, _, _) in self.slots.items()})
