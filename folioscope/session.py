"""Spark session defaults, the shared scratch folder and small scale helpers."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app="folioscope", master=None, **conf):
    """A session with the settings the jobs are tuned for; ``conf`` overrides them.

    On a cluster the master, memory and shuffle settings come from spark-submit.
    """
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.enabled": "false",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_folder(spark):
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a
    machine-local folder would be invisible to the other executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_scratch_folders = {}


def _scratch_folder(spark):
    """A folder of this application in the shared one; it goes when the application ends."""
    key = (spark.sparkContext.applicationId, _shared_folder(spark))
    if key not in _scratch_folders:
        path = f"{key[1]}/scratch-{key[0]}-{uuid.uuid4().hex[:8]}"
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
        _scratch_folders[key] = path
    return _scratch_folders[key]


def scratch_path(spark, name):
    """A new path in the shared folder, kept until the application ends."""
    return f"{_scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder once, whatever reads them afterwards."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name="stored", **options) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    For a small result of costly work, such as search hits: whatever reads it next does
    not repeat the work, and since the size of a table is known, a join broadcasts it
    exactly when it is below the session's threshold.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys) -> DataFrame:
    """Use all cores when a scan yields fewer splits than there are cores.

    For scans: asking a plan with shuffles for its partitions would run them. A table of many files already has enough splits and is returned unchanged, so this
    adds a shuffle to small inputs only. Give unique ``keys`` where there are any: a
    round-robin shuffle has to sort the rows to be repeatable.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
