"""Images from files: directory scans, the formats that need no codec, and batches."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions.columns import file_name_parts


def scan_images(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("jpg", "png", "ppm")) -> DataFrame:
    """(path, name, country, id, content) of image files below a directory; the id is in the name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions)).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    country, ident = file_name_parts(F.col("name"))
    return files.select("path", "name", country.alias("country"), ident.alias("id"), "content")


def with_images(items: DataFrame, images: DataFrame, id_col: str = "id") -> DataFrame:
    """Items that have an image, beside it; files without an item add nothing."""
    return items.join(images, id_col, "inner")


def decode_ppm(content: bytes) -> np.ndarray:
    """float[h][w][3] in [0, 1] of a binary PPM (P6, 8 bits)."""
    parts, at = [], 0
    while len(parts) < 4:
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at)
            continue
        end = at
        while not content[end : end + 1].isspace():
            end += 1
        parts.append(content[at:end])
        at = end
    if parts[0] != b"P6":
        raise ValueError("not a binary PPM")
    w, h, top = map(int, parts[1:])
    return np.frombuffer(content, np.uint8, w * h * 3, at + 1).reshape(h, w, 3) / top


def encode_ppm(img: np.ndarray) -> bytes:
    h, w = img.shape[:2]
    return b"P6\n%d %d\n255\n" % (w, h) + np.rint(np.clip(img, 0, 1) * 255).astype(np.uint8).tobytes()


def resized(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Nearest neighbour."""
    y = np.minimum((np.arange(height) + 0.5) * img.shape[0] / height, img.shape[0] - 1).astype(int)
    x = np.minimum((np.arange(width) + 0.5) * img.shape[1] / width, img.shape[1] - 1).astype(int)
    return img[y][:, x]


def decoded(images: DataFrame, height: int = 48, width: int = 48) -> DataFrame:
    """(id, vec): pixels of one size as a flat array, rows first; files that aren't PPM are an error."""
    decode, fit = decode_ppm, resized

    def run(batches: Iterable) -> Iterable:
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"id": b["id"], "vec": [fit(decode(c), height, width).ravel() for c in b["content"]]})

    return images.select("id", "content").mapInPandas(run, "id string, vec array<double>")


def batches(df: DataFrame, vec: str, size: int) -> DataFrame:
    """(batch, rows): arrays of `size` vectors, within partitions; the last of one may be smaller."""
    def run(frames: Iterable) -> Iterable:
        import pandas as pd

        held, k = [], 0
        for f in frames:
            held += list(f[vec])
            while len(held) >= size:
                yield pd.DataFrame({"batch": [k], "rows": [held[:size]]})
                held, k = held[size:], k + 1
        if held:
            yield pd.DataFrame({"batch": [k], "rows": [held]})

    return df.select(vec).mapInPandas(run, "batch long, rows array<array<double>>")
