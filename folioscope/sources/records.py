"""Rating records: fields of a search result with the nested list of responses."""

from pyspark.sql import DataFrame

from .. import schemas
from . import files


def read(spark, path, schema=schemas.RATING_RECORD) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(path)


def create_if_absent(df: DataFrame, path):
    """Write only when there is no complete data set, so a rerun adds nothing and a crash costs nothing."""
    if not files.is_complete(df.sparkSession, path):
        append(df, path, run="first")


def append(df: DataFrame, path, run=None):
    """Add to the data set; a job that is repeated under its ``run`` key adds nothing."""
    files.append_run(df, path, lambda writer, folder: writer.json(folder), run)
