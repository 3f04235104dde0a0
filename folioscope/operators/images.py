"""Image relevance: large enough, and not one uniform colour."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V


def large_enough(width, height, min_width=V.MIN_IMAGE_WIDTH, min_height=V.MIN_IMAGE_HEIGHT):
    return (F.col(width) >= min_width) & (F.col(height) >= min_height)


def _luma_deviation(channels: pd.Series, data: pd.Series) -> pd.Series:
    def deviation(n, raw):
        if raw is None:
            return None
        pixels = np.frombuffer(raw, dtype=np.uint8)
        if n == 1:
            return float(pixels.std())
        pixels = pixels.reshape(-1, n)
        grey = pixels[:, 2] * np.uint32(19595)
        grey += pixels[:, 1] * np.uint32(38470)
        grey += pixels[:, 0] * np.uint32(7471)
        grey += np.uint32(0x8000)
        grey >>= np.uint32(16)
        return float(grey.std())

    return pd.Series([deviation(n, raw) for n, raw in zip(channels, data)], dtype="float64")


def grey_stddev(images: DataFrame, image="image") -> DataFrame:
    """Adds the population deviation of the grey values of decoded images.

    ``image`` is the struct of Spark's image source (BGR or BGRA bytes, or one grey
    channel). Grey is the usual luma in 16-bit fixed point. Only the pixels go to
    Python, in Arrow batches, and each image once.
    """
    deviation = F.pandas_udf(_luma_deviation, "double").asNondeterministic()
    return images.withColumn("grey_std", deviation(f"{image}.nChannels", f"{image}.data"))


def keep_images(images: DataFrame, image="image", min_width=V.MIN_IMAGE_WIDTH,
                min_height=V.MIN_IMAGE_HEIGHT, min_std=V.MIN_GREY_STDDEV) -> DataFrame:
    """Relevant images of an image-source table. The size test runs first, so pixels of
    small images never leave the JVM."""
    large = images.filter(large_enough(f"{image}.width", f"{image}.height", min_width, min_height))
    return grey_stddev(large, image).filter(F.col("grey_std") >= min_std)


def keep_pixel_tables(pixels: DataFrame, key="image_id", min_width=V.MIN_IMAGE_WIDTH,
                      min_height=V.MIN_IMAGE_HEIGHT, min_std=V.MIN_GREY_STDDEV) -> DataFrame:
    """The same for a table with one row per pixel ``(key, width, height, grey)``."""
    return (
        pixels.filter(large_enough("width", "height", min_width, min_height))
        .groupBy(key, "width", "height")
        .agg(F.stddev_pop("grey").alias("grey_std"))
        .filter(F.col("grey_std") >= min_std)
    )
