"""Tables in the folder that all executors share."""

from ..session import scratch_path

FILE_ROWS = 100_000  # rows without texts that are worth a file and a task of their own


def scratch(df, name):
    """(path, table): ``df`` written to the shared folder and read back.

    The driver then drops what it no longer needs, on which Spark deletes the shuffle files
    of the steps behind the table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    spark._jvm.System.gc()
    return path, spark.read.schema(df.schema).parquet(path)


def stored(df, name="stored", rows=None):
    """``scratch``'s table. ``rows``: there are at most so many, of a few numbers each.

    They are written by as many tasks as so many rows are worth, and by all cores at least. A small table would else have a file
    for each partition of the shuffle before it, and each of them costs a task, its folder and, on a local disk,
    processes that set permissions.
    """
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    return scratch(df, name)[1]


def released(spark, path):
    """Delete a table of this part that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
