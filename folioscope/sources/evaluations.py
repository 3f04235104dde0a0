"""The evaluation log: JSON lines, one vote per line."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import schemas
from . import files

_BAD = "_bad_line"


def parse_lines(lines: DataFrame, schema=schemas.EVALUATION) -> DataFrame:
    """Parse a ``value`` column of JSON text; blank and broken lines are left out.

    Works on batch and streaming input. Parsing as an expression keeps the check for
    bad lines independent of the columns a query happens to need.
    """
    with_bad = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType(), True)])
    row = F.from_json(
        "value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    )
    return (
        lines.filter(F.length(F.trim("value")) > 0)
        .select(row.alias("row"))
        .filter(F.col("row").isNotNull() & F.col(f"row.{_BAD}").isNull())
        .select(*[F.col(f"row.{name}").alias(name) for name in schema.fieldNames()])
    )


def read(spark, path) -> DataFrame:
    return parse_lines(spark.read.option("recursiveFileLookup", True).text(path))


def read_stream(spark, path, max_files=None) -> DataFrame:
    reader = spark.readStream.option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_lines(reader.text(path))


def append(df: DataFrame, path, run=None):
    """The file commit makes an append all or nothing, ``run`` makes it happen once; non-ASCII text stays as it is."""
    files.append_run(df.select(*schemas.EVALUATION.fieldNames()), path, lambda writer, folder: writer.json(folder), run)


def event_time(col="timestamp") -> Column:
    """The ISO text as a timestamp; a bad value is null."""
    return F.try_to_timestamp(F.col(col))
