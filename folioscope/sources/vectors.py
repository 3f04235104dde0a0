"""The vector store: one keyed Parquet table, a folder per approach and type, replaced in one step."""

from pyspark.sql import DataFrame, functions as F

from .. import schemas
from . import versions

PARTITIONS = ("approach_id", "type")


def write(items: DataFrame, path, run=None):
    """Add built items, once per run key. Nothing is shuffled: a task sorts its own rows by folder and
    writes one file for each approach it has rows of."""
    versions.append(_as_stored(items), path, run, PARTITIONS)


def _as_stored(items):
    """Coordinates are stored as float, whatever they were computed in."""
    return items.withColumn("vector", F.col("vector").cast("array<float>"))


def replace_approach(items: DataFrame, path, approach_ids, run=None):
    """Rebuild the named approaches and leave the others as they are; searches see either all of the old or all of the new."""
    versions.replace_groups(_as_stored(items), path, "approach_id", approach_ids, run, PARTITIONS)


def read(spark, path, approach_ids=None, schema=schemas.VECTOR_ITEM) -> DataFrame:
    df = versions.read(spark, path, schema, "approach_id")
    return df if approach_ids is None else df.filter(F.col("approach_id").isin(list(approach_ids)))


def build_status(items: DataFrame, registry: DataFrame) -> DataFrame:
    """Items per registered approach; an approach nobody built is reported, not an error."""
    sizes = items.groupBy("approach_id").agg(F.count(F.lit(1)).alias("items"))
    return registry.select("approach_id").join(sizes, "approach_id", "left").select(
        "approach_id",
        F.coalesce("items", F.lit(0)).cast("bigint").alias("items"),
        F.col("items").isNotNull().alias("built"),
    )


def failures(items: DataFrame) -> DataFrame:
    """Zero vectors per approach and type: inputs that were missing or could not be encoded."""
    zero = F.array_max("vector") == F.array_min("vector")
    zero = zero & (F.array_max("vector") == 0)
    return items.groupBy(*PARTITIONS).agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.coalesce(zero, F.lit(True))).alias("failed"))
