import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import images
from folioscope.sources import pages
from tests.conftest import plan


def png(pixels):
    """A PNG file of an array (height, width, 3), or (height, width) for grey."""
    height, width = pixels.shape[:2]
    colour = 2 if pixels.ndim == 3 else 0

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(height))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def grey_of(rgb):
    r, g, b = (rgb[..., i].astype(np.int64) for i in range(3))
    return (r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("images")
    flat = np.zeros((110, 120, 3), np.uint8)
    flat[..., 0] = 255
    ramp = np.repeat(np.tile((np.arange(120) * 2).astype(np.uint8), (110, 1))[..., None], 3, axis=2)
    noise = np.random.default_rng(0).integers(0, 255, (100, 100, 3)).astype(np.uint8)
    one_channel = np.tile((np.arange(120) * 2).astype(np.uint8), (110, 1))
    for name, pixels in {"flat": flat, "ramp": ramp, "noise": noise, "grey": one_channel,
                         "narrow": ramp[:, :50].copy(), "low": ramp[:99].copy()}.items():
        (path / f"{name}.png").write_bytes(png(pixels))
    (path / "junk.png").write_bytes(b"not an image")
    return str(path), {"ramp": grey_of(ramp).std(), "noise": grey_of(noise).std(), "grey": one_channel.std()}


def test_image_files(spark, folder):
    path, expected = folder
    found = pages.read_images(spark, path)
    assert {r.id for r in found.select("id").collect()} == {"flat", "ramp", "noise", "grey", "narrow", "low"}
    got = {r.id: r.grey_std for r in images.keep_images(found).select("id", "grey_std").collect()}
    assert got == pytest.approx(expected)


def test_small_images_do_not_reach_python(spark, folder):
    text = plan(images.keep_images(pages.read_images(spark, folder[0])))
    python = text.index("ArrowEvalPython")
    assert text.count("ArrowEvalPython") == 1
    assert "width" in text[python:] and ">= 100" in text[python:]


def test_pixel_table(spark):
    rows = [(1, 100, 100, float(g)) for g in (0, 40)] + [(2, 100, 100, 5.0), (2, 100, 100, 6.0)] + [(3, 99, 100, float(g)) for g in (0, 255)]
    df = spark.createDataFrame(rows, "image_id int, width int, height int, grey double")
    assert [(r.image_id, r.grey_std) for r in images.keep_pixel_tables(df).collect()] == [(1, 20.0)]


def test_image_bytes(spark, folder):
    rows = pages.read_image_bytes(spark, folder[0]).collect()
    assert len(rows) == 7 and all(len(r.content) > 5 for r in rows)
