"""Retrieval quality of a running vote log: the figures of the batch job, kept up to date.

A result is counted once however often it is voted on, and a vote may make a result relevant
that other approaches returned long ago. So two keyed states follow each other. The first holds flags per result
of a query: who returned it, is it relevant. A vote that sets a new flag sends differences of the query's
set sizes. The second holds these sizes per query and sends out corrections: by how much the query's
precision, recall and F1 under each approach have changed. Their sums per approach are a
table of a few rows, replaced in one step per batch. Corrections are whole numbers, so they cancel exactly.
"""

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import votes
from ..sources import versions

SHARDS = 32  # parts of a query's results; a hot query is the work of as many tasks
ONE = 1 << 32  # corrections are multiples of 1 / ONE
FIGURES = ("precision", "recall", "f1")
STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TOTALS = T.StructType([T.StructField("approach_id", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("queries", *FIGURES)]])


def session(spark, partitions=None):
    """A session with the state store that keyed state needs. A query keeps its number of state partitions for good."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STATE)
    if partitions:
        own.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return own


class _Flags(StatefulProcessor):
    """Flags per result in, differences of set sizes out. Bit i: returned by approach i; the last bit: relevant."""

    def __init__(self, n):
        self.n = n

    def init(self, handle: StatefulProcessorHandle):
        self.flags = handle.getMapState("flags", "result string", "bits int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = {}
        for part in rows:
            for result, bits in zip(part["result"], part["bits"]):
                seen[result] = seen.get(result, 0) | int(bits)
        relevant, retrieved, hits = 0, [0] * self.n, [0] * self.n
        mark = 1 << self.n
        for result, bits in seen.items():
            old = self.flags.getValue((result,))[0] if self.flags.containsKey((result,)) else 0
            new = old | bits
            if new == old:
                continue
            self.flags.updateValue((result,), (new,))
            relevant += (new & mark > 0) - (old & mark > 0)
            for i in range(self.n):
                retrieved[i] += (new >> i & 1) - (old >> i & 1)
                hits[i] += (new >> i & 1 and new & mark > 0) - (old >> i & 1 and old & mark > 0)
        if relevant or any(retrieved):
            yield pd.DataFrame({"query": [key[0]], "relevant": [relevant], "retrieved": [retrieved], "hits": [hits]})

    def close(self):
        pass


class _Sizes(StatefulProcessor):
    """Differences of set sizes in, corrections of a query's figures out."""

    def __init__(self, approach_ids):
        self.ids = approach_ids

    def init(self, handle: StatefulProcessorHandle):
        self.sizes = handle.getValueState("sizes", "relevant long, retrieved array<long>, hits array<long>")

    def _figures(self, relevant, retrieved, hits):
        """(1, precision, recall, F1) in whole numbers; zeros where the query is no part of the mean."""
        if not relevant or not retrieved:
            return 0, 0, 0, 0
        p, r = hits / retrieved, hits / relevant
        f = 2 * (p * r) / (p + r) if hits else 0.0
        return 1, round(p * ONE), round(r * ONE), round(f * ONE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = len(self.ids)
        old = self.sizes.get() if self.sizes.exists() else (0, [0] * n, [0] * n)
        relevant, retrieved, hits = int(old[0]), [int(x) for x in old[1]], [int(x) for x in old[2]]
        for part in rows:
            relevant += int(part["relevant"].sum())
            for name, total in (("retrieved", retrieved), ("hits", hits)):
                for more in part[name]:
                    for i in range(n):
                        total[i] += int(more[i])
        self.sizes.update((relevant, retrieved, hits))
        out = []
        for i, approach_id in enumerate(self.ids):
            before = self._figures(int(old[0]), int(old[1][i]), int(old[2][i]))
            now = self._figures(relevant, retrieved[i], hits[i])
            if now != before:
                out.append((approach_id, *[b - a for a, b in zip(before, now)]))
        if out:
            yield pd.DataFrame(out, columns=["approach_id", "queries", *FIGURES])

    def close(self):
        pass


def _combined(rows):
    """One row per result of a query and Arrow batch, so a hot result shrinks before the shuffle."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            table = pa.Table.from_batches([b])
            flags = [c for c in table.column_names if c.startswith("f")]
            some = table.group_by(["query", "shard", "result"]).aggregate([(c, "max") for c in flags])
            bits = None
            for i, c in enumerate(flags):
                one = pa.compute.multiply(some.column(f"{c}_max"), pa.scalar(1 << i, pa.int32()))
                bits = one if bits is None else pa.compute.add(bits, one)
            out = pa.table({"query": some.column("query"), "shard": some.column("shard"), "result": some.column("result"), "bits": bits})
            yield from out.combine_chunks().to_batches()

    return rows.mapInArrow(run, "query string, shard int, result string, bits int")


def corrections(stream: DataFrame, approach_ids=votes.ALL_APPROACHES) -> DataFrame:
    """(approach_id, queries, precision, recall, f1): what each batch changes, in multiples of 1 / ``ONE``."""
    ids = list(approach_ids)
    result = F.coalesce(F.concat(F.lit("r"), F.col("result_id").cast("string")), F.lit("-"))
    flags = [F.coalesce((F.col("approach_id") == a).cast("int"), F.lit(0)).alias(f"f{i}") for i, a in enumerate(ids)]
    rows = stream.filter(F.col("query").isNotNull()).select(
        F.col("query").cast("string").alias("query"), F.pmod(F.xxhash64(result), F.lit(SHARDS)).cast("int").alias("shard"), result.alias("result"),
        *flags, votes.relevance().alias(f"f{len(ids)}"))
    sizes = _combined(rows).groupBy("query", "shard").transformWithStateInPandas(
        _Flags(len(ids)), "query string, relevant long, retrieved array<long>, hits array<long>", "Append", "None")
    return sizes.groupBy("query").transformWithStateInPandas(_Sizes(ids), TOTALS, "Append", "None")


def write(stream: DataFrame, out, checkpoint, approach_ids=votes.ALL_APPROACHES):
    """Keep the sums per approach at ``out``. A batch that is repeated after a crash changes nothing.

    The stream's session must have the state store of ``session``.
    """
    def batch(changes, number):
        spark = changes.sparkSession
        totals = [F.sum(n).alias(n) for n in ("queries", *FIGURES)]
        # one row per approach; also run where the commit is there already, since the states advance with it
        new = spark.createDataFrame(changes.groupBy("approach_id").agg(*totals).collect(), TOTALS)
        rows = versions.read(spark, out, TOTALS).unionByName(new).groupBy("approach_id").agg(*totals)
        versions.replace(rows.coalesce(1), out, f"{checkpoint}#{number}", forget=True)
        versions.clean_up(spark, out)

    return (
        corrections(stream, approach_ids).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .foreachBatch(batch).trigger(availableNow=True).start()
    )


def read(spark, out, registry: DataFrame) -> DataFrame:
    """The metric table as of the last batch; a registered approach without queries has zeros."""
    sums = versions.read(spark, out, TOTALS).filter("queries > 0")
    means = [F.coalesce(F.col(n) / (F.col("queries") * F.lit(float(ONE))), F.lit(0.0)).alias(n) for n in FIGURES]
    return registry.select("approach_id").join(sums, "approach_id", "left").select(
        "approach_id", *means, F.coalesce("queries", F.lit(0)).cast("long").alias("queries"))
