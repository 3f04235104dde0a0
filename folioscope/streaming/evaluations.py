"""The evaluation log as a stream."""

from pyspark.sql import DataFrame, functions as F, types as T

from ..operators import votes
from ..sources import evaluations, versions

PRECISION = T.StructType([T.StructField("approach_id", T.StringType()), T.StructField("votes", T.LongType()), T.StructField("precision", T.DoubleType())])


def ingest(spark, folder, out, checkpoint, max_files=None):
    """Votes that arrive as JSON files go to Parquet, each exactly once.

    Broken lines and votes without an evaluator are left out. The call processes what is
    there and returns; the checkpoint remembers it for the next call.
    """
    clean = votes.storable(evaluations.read_stream(spark, folder, max_files))
    return (
        clean.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def running_precision(stream: DataFrame) -> DataFrame:
    """Votes and share of relevant ones per approach; use with complete output mode.

    State is one row per approach.
    """
    return votes.labelled(stream).groupBy("approach_id").agg(
        F.count(F.lit(1)).alias("votes"), F.avg("is_relevant").alias("precision")
    )


def write_running_precision(stream: DataFrame, out, checkpoint):
    """Keep the current table at ``out``; every batch takes the place of the last in one step."""
    def replace(batch, number):
        versions.replace(batch, out, f"{checkpoint}#{number}", forget=True)
        versions.clean_up(batch.sparkSession, out)

    return (
        running_precision(stream).writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(replace).trigger(availableNow=True).start()
    )


def read_running_precision(spark, out) -> DataFrame:
    return versions.read(spark, out, PRECISION)
