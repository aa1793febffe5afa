"""Pictures of listings: decoded by Spark's image source, described by 43 numbers each.

Decoding runs in the JVM and the numbers are made where a picture was read, in Arrow batches of
pixel arrays; only the numbers move. A folder holds the pictures of one listing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brickyard.functions import fixed

#: Side of the square to which a picture is brought.
SIDE = 224
#: Bits after the point of the resampling weights.
_BITS = 22
#: Bytes of decoded pictures that a Python task gets at once (a larger picture comes alone).
BATCH_BYTES = 32 << 20


def _cubic(x: np.ndarray) -> np.ndarray:
    """The cubic convolution kernel with a = -0.5."""
    x = np.abs(x)
    near, far = (1.5 * x - 2.5) * x * x + 1, ((-0.5 * x + 2.5) * x - 4) * x + 2
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


def _squeezed(pixels: np.ndarray, size: int) -> np.ndarray:
    """The second axis resampled to ``size``; when shrinking the kernel widens, so every pixel counts."""
    old = pixels.shape[1]
    if old == size:
        return pixels
    scale = old / size
    wide = max(scale, 1.0)
    out = np.empty((pixels.shape[0], size, pixels.shape[2]), np.uint8)
    values = pixels.astype(np.float64)
    for k in range(size):
        centre = (k + 0.5) * scale
        first, last = max(int(centre - 2 * wide + 0.5), 0), min(int(centre + 2 * wide + 0.5), old)
        w = _cubic((np.arange(first, last) - centre + 0.5) / wide)
        w = w / w.sum() * (1 << _BITS)
        w = np.trunc(w + np.copysign(0.5, w))
        # Whole numbers below 2^53: the sums are exact in any order.
        total = np.tensordot(values[:, first:last], w, ([1], [0])) + (1 << (_BITS - 1))
        out[:, k] = np.clip(np.floor(total / (1 << _BITS)), 0, 255)
    return out


def resized(pixels: np.ndarray, side: int = SIDE) -> np.ndarray:
    """A picture (height, width, channels) of bytes as a square, by cubic convolution along rows, then along columns."""
    return _squeezed(_squeezed(pixels, side).transpose(1, 0, 2), side).transpose(1, 0, 2)


def _moved(a: np.ndarray, down: int, right: int) -> np.ndarray:
    """The padded array's inside, looked up one step away."""
    h, w = a.shape
    return a[1 + down : h - 1 + down, 1 + right : w - 1 + right]


def edges(gray: np.ndarray, low: int, high: int) -> np.ndarray:
    """Canny edges: Sobel gradients, thinned across four directions, weak ones kept where strong ones reach them."""
    p = np.pad(gray.astype(np.int64), 1, mode="edge")
    dx = _moved(p, -1, 1) + 2 * _moved(p, 0, 1) + _moved(p, 1, 1) - _moved(p, -1, -1) - 2 * _moved(p, 0, -1) - _moved(p, 1, -1)
    dy = _moved(p, 1, -1) + 2 * _moved(p, 1, 0) + _moved(p, 1, 1) - _moved(p, -1, -1) - 2 * _moved(p, -1, 0) - _moved(p, -1, 1)
    size = np.abs(dx) + np.abs(dy)
    around = np.pad(size, 1)
    # Tangents of 22.5 and 67.5 degrees in fixed point.
    flat = np.abs(dx) * fixed.TANGENT_22
    steep = flat + (np.abs(dx) << 16)
    rise = np.abs(dy) << 15
    level, upright = rise < flat, rise > steep
    down_right = ~level & ~upright & ((dx < 0) == (dy < 0))
    keep = np.where(
        level, (size > _moved(around, 0, -1)) & (size >= _moved(around, 0, 1)),
        np.where(
            upright, (size > _moved(around, -1, 0)) & (size >= _moved(around, 1, 0)),
            np.where(
                down_right, (size > _moved(around, -1, -1)) & (size > _moved(around, 1, 1)), (size > _moved(around, -1, 1)) & (size > _moved(around, 1, -1))
            ),
        ),
    )
    weak = keep & (size > low)
    found = weak & (size > high)
    while True:
        p = np.pad(found, 1)
        grown = weak & np.logical_or.reduce([_moved(p, a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)])
        if (grown == found).all():
            return found
        found = grown


def _gray(rgb: np.ndarray) -> np.ndarray:
    """Luma in fixed point of 15 bits, rounded."""
    r, g, b = (rgb[:, :, k].astype(np.int64) for k in range(3))
    wr, wg, wb = fixed.LUMA_WEIGHTS
    return ((r * wr + g * wg + b * wb + (1 << 14)) >> 15).astype(np.uint8)


def _saturation(rgb: np.ndarray) -> np.ndarray:
    """(max - min) * 255 / max as a byte, by a table of reciprocals in fixed point of 12 bits."""
    top = rgb.max(axis=2).astype(np.int64)
    spread = top - rgb.min(axis=2)
    share = np.concatenate([[0], np.rint((255 << 12) / np.arange(1, 256))]).astype(np.int64)
    return ((spread * share[top] + (1 << 11)) >> 12).astype(np.uint8)


def features(rgb: np.ndarray) -> list[float]:
    """The numbers of a square picture of bytes (side, side, 3: red, green, blue), in the order of fixed.PICTURE_FEATURES."""
    parts = rgb.astype(np.float32) / np.float32(255)
    # A byte divided by 255 and multiplied again may fall just below itself and then loses one.
    again = (parts * np.float32(255)).astype(np.uint8)
    share = parts.astype(np.float64)
    s, v = (x.astype(np.float64) / 255 for x in (_saturation(again), again.max(axis=2)))
    gray = _gray(again)
    p = np.pad(gray.astype(np.float64), 1, mode="reflect")
    curve = _moved(p, 0, 1) + _moved(p, 0, -1) + _moved(p, 1, 0) + _moved(p, -1, 0) - 4 * _moved(p, 0, 0)
    rg, yb = np.abs(share[:, :, 0] - share[:, :, 1]), np.abs((share[:, :, 0] + share[:, :, 1]) / 2 - share[:, :, 2])
    tones = np.bincount(gray.ravel(), minlength=256) / gray.size
    tones = tones[tones > 0]
    shade = gray / 255
    bins = np.minimum(rgb.astype(np.int64) * 8 // 255, 7)
    out = [
        *share.mean(axis=(0, 1)), *share.std(axis=(0, 1)), s.mean(), s.std(), v.mean(), v.std(), shade.mean(), shade.std(),
        edges(gray, *fixed.EDGE_LEVELS).mean(), curve.var() / 10_000, (gray < fixed.DARK).mean(), (gray > fixed.BRIGHT).mean(), (s.astype(np.float32) < np.float32(fixed.NEUTRAL)).mean(),
        np.sqrt(rg.var() + yb.var()) + 0.3 * np.sqrt(rg.mean() ** 2 + yb.mean() ** 2), -(tones * np.log2(tones)).sum() / 8,
    ]
    for k in range(3):
        out += (np.bincount(bins[:, :, k].ravel(), minlength=8) / gray.size).tolist()
    return [float(x) for x in out]


def pixels_of(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Red, green and blue of a decoded picture; gray ones thrice, and transparency left out."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, 2::-1]


def picture_features(image: Column) -> Column:
    """The numbers of a column of Spark's decoded images (a struct); null where a file is no picture.

    Pictures of any size are brought to one square first; a picture is held twice while its batch is worked on.
    """

    @F.pandas_udf("array<double>")
    def work(images: pd.DataFrame) -> pd.Series:
        out = []
        for h, w, c, data in zip(images["height"], images["width"], images["nChannels"], images["data"]):
            out.append(features(resized(pixels_of(h, w, c, data))) if h > 0 and w > 0 else None)
        return pd.Series(out, dtype=object)

    return work(F.struct(*(image[x].alias(x) for x in ("height", "width", "nChannels", "data"))))


def read_pictures(spark: SparkSession, path: str, glob: str = "*.jpg") -> DataFrame:
    """``path, width, height, features`` of the pictures in a folder and those below it; of files that are none, nulls.

    Files are decoded by the tasks that read them. The session's Arrow batches are bounded by bytes from here on, as rows
    are whole pictures.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    image = F.col("image")
    rows = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    size = [F.when(image[x] > 0, image[x]).alias(x) for x in ("width", "height")]
    return rows.select(image["origin"].alias("path"), *size, picture_features(image).alias("features"))


def large_enough(pictures: DataFrame) -> DataFrame:
    """Pictures that are worth keeping: not below the least width and height."""
    return pictures.where((F.col("width") >= fixed.LEAST_WIDTH) & (F.col("height") >= fixed.LEAST_HEIGHT))


def folder_of(number: Column) -> Column:
    """The folder of a listing's pictures: the digits of its number, "unknown" for none."""
    digits = F.regexp_replace(F.coalesce(number.cast("string"), F.lit("")), "[^0-9]", "")
    return F.when(digits == "", "unknown").otherwise(digits)


def pictures_of_rows(rows: DataFrame, pictures: DataFrame, most: int, key: str = "ord", number: str = "№") -> DataFrame:
    """(key, path, features): the first ``most`` pictures by name of each row's folder.

    A file that is no picture takes its place among the first, without features. Only names and numbers are shuffled.
    """
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    ranked = pictures.select("path", "features", folder.alias("folder")).withColumn("k", F.row_number().over(Window.partitionBy("folder").orderBy("path")))
    return rows.select(key, folder_of(F.col(number)).alias("folder")).join(ranked.where(F.col("k") <= most).drop("k"), "folder").drop("folder")
