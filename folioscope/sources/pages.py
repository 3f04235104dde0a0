"""Document pages and images."""

from pyspark.sql import Column, DataFrame, functions as F


def read_page_files(spark, path) -> DataFrame:
    """One text file per page, named ``<doc>_<page>.txt``."""
    name = F.regexp_extract("path", r"([^/]+)_(\d+)\.txt$", 1)
    page = F.regexp_extract("path", r"([^/]+)_(\d+)\.txt$", 2)
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
        .select(
            name.alias("doc_id"),
            page.try_cast("int").alias("page"),
            F.decode("content", "UTF-8").alias("text"),
        )
    )


def read_images(spark, path) -> DataFrame:
    """Decoded images; files that are no image are dropped. Id = file name without suffix."""
    return (
        spark.read.format("image").option("dropInvalid", True).load(path)
        .select(
            F.regexp_extract("image.origin", r"([^/]+?)(\.[^./]*)?$", 1).alias("id"),
            "image",
        )
    )


def relative_path(path, root) -> Column:
    """A file's path below ``root``; a relative one, or one elsewhere, stays as it is.

    URI schemes and doubled slashes do not count, so ``file:/a/b.png``, ``file:///a/b.png``
    and ``/a/b.png`` are one file.
    """
    def plain(c):
        return F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:", ""), r"/{2,}", "/")

    path = F.col(path) if isinstance(path, str) else path
    base = F.concat(F.rtrim(plain(F.lit(root)), F.lit("/")), F.lit("/"))
    return F.when(F.startswith(plain(path), base), F.substr(plain(path), F.length(base) + 1)).otherwise(plain(path))


def qualified(spark, path):
    """A folder as Spark names it in the paths of its files."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path or ".")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def parent(path):
    """The folder that holds a folder."""
    return path.rstrip("/").rpartition("/")[0]


def read_image_bytes(spark, path, root=None) -> DataFrame:
    """The files below ``path``. Their paths are relative to ``root``, by default the folder that
    holds ``path``: annotations name their images as ``images/<id>.png``."""
    root = qualified(spark, parent(path)) if root is None else root
    return spark.read.format("binaryFile").load(path).select(
        relative_path("path", root).alias("content_path"), "content"
    )
