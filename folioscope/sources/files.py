"""Folders of files: not written yet, written once per run."""

from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame


def read_parquet(spark, path, schema) -> DataFrame:
    """A folder nobody has written yet is an empty table."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _there(spark, pattern):
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where))


def is_complete(spark, path):
    """Did a write to this folder, or of a run in it, end well?"""
    return any(_there(spark, f"{path.rstrip('/')}/{x}_SUCCESS") for x in ("", "run=*/"))


def append_run(df: DataFrame, path, write, run=None, **options):
    """``write(writer, folder)`` adds the rows of ``df`` to the folder, once per run key.

    A run has a sub-folder of its own. A complete one is left as it is, what a crash left of
    another is written anew, so repeating a job changes nothing. Without a key rows are added
    on every call. Readers look into sub-folders.
    """
    if run is None:
        write(df.write.mode("append").options(**options), path)
        return
    folder = f"{path.rstrip('/')}/run={quote(str(run), safe='')}"
    if not _there(df.sparkSession, f"{folder}/_SUCCESS"):
        write(df.write.mode("overwrite").options(**options), folder)
