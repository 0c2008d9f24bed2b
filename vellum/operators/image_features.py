"""Features of images given as rows of gray pixels, and how alike two images are by them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sides of the pictures that the features are taken of: pixels go row by row.
DHASH_WIDTH, HASH_SIDE, BINARY_SIDE = 17, 16, 128
#: What keeps the likeness of structure from dividing by nothing.
C1, C2 = 6.5025, 58.5225


def dhash(pixels: Column) -> Column:
    """256 bits of a picture of 17 by 16: whether each pixel is lighter than the one on its right."""
    place = lambda i: (F.floor(i / HASH_SIDE) * DHASH_WIDTH + i % HASH_SIDE).cast("int")
    bit = lambda i: (F.get(pixels, place(i)) > F.get(pixels, place(i) + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(HASH_SIDE * HASH_SIDE - 1)), bit)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def phash(pixels: pd.Series) -> pd.Series:
    """63 bits of a picture of 16 by 16: whether each low frequency but the first is above their median. Null for a picture of another size."""
    waves = np.cos((2 * np.arange(HASH_SIDE)[None, :] + 1) * np.arange(8)[:, None] * np.pi / (2 * HASH_SIDE))
    fits = [i for i, v in enumerate(pixels) if v is not None and len(v) == HASH_SIDE * HASH_SIDE]
    out: list[np.ndarray | None] = [None] * len(pixels)
    if fits:
        stack = np.stack([pixels.iloc[i] for i in fits]).astype(float).reshape(-1, HASH_SIDE, HASH_SIDE)
        low = (waves @ stack @ waves.T).reshape(len(stack), -1)[:, 1:]
        for i, bits in zip(fits, (low > np.sort(low, axis=1)[:, low.shape[1] // 2, None]).astype(np.int32)):
            out[i] = bits
    return pd.Series(out, dtype=object)


def bit_distance(a: Column, b: Column) -> Column:
    """Places in which two lists of bits differ; what one is longer counts too."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda x: x))


def hash_score(dhash_a: Column, dhash_b: Column, phash_a: Column, phash_b: Column) -> Column:
    """Likeness by both hashes, from 0 to 1."""
    return 1 - (bit_distance(dhash_a, dhash_b) / 256 + bit_distance(phash_a, phash_b) / 63) / 2


def thresholds(pixels: np.ndarray) -> np.ndarray:
    """For each row of pixels the value at which the variance between both sides is greatest."""
    counts = np.bincount((pixels + 256 * np.arange(len(pixels))[:, None]).reshape(-1), minlength=256 * len(pixels)).reshape(-1, 256).astype(float)
    below, weighted = np.cumsum(counts, axis=1), np.cumsum(counts * np.arange(256), axis=1)
    above = below[:, -1:] - below
    both = (below > 0) & (above > 0)
    means = weighted / np.where(both, below, 1) - (weighted[:, -1:] - weighted) / np.where(both, above, 1)
    return np.where(both, below * above * means**2, 0.0).argmax(axis=1)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def black_and_white(pixels: pd.Series) -> pd.Series:
    """Pixels as 0 or 255, parted where the variance between both sides is greatest. Null for a picture without pixels."""
    sizes = np.array([0 if v is None else len(v) for v in pixels], int)
    out: list[np.ndarray | None] = [None] * len(pixels)
    for size in np.unique(sizes[sizes > 0]):
        own = np.flatnonzero(sizes == size)
        stack = np.stack([pixels.iloc[i] for i in own]).astype(np.int64)
        for i, values in zip(own, np.where(stack > thresholds(stack)[:, None], 255, 0).astype(np.int32)):
            out[i] = values
    return pd.Series(out, dtype=object)


def agreement(a: Column, b: Column) -> Column:
    """Share of pixels that are the same."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def structure(a: Column, b: Column) -> Column:
    """Likeness of means, variances and covariance of two pictures as a whole, from sums of one pass over both."""
    sums = {"n": lambda x, y: F.lit(1.0), "a": lambda x, y: x, "b": lambda x, y: y, "aa": lambda x, y: x * x, "bb": lambda x, y: y * y, "ab": lambda x, y: x * y}
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    added = lambda s, v: F.struct(*[(s[k] + f(v["x"], v["y"])).alias(k) for k, f in sums.items()])

    def likeness(s: Column) -> Column:
        mean_a, mean_b = s["a"] / s["n"], s["b"] / s["n"]
        spread = lambda xy, x, y: (s[xy] - s[x] * s[y] / s["n"]) / (s["n"] - 1)
        return (2 * mean_a * mean_b + C1) * (2 * spread("ab", "a", "b") + C2) / ((mean_a * mean_a + mean_b * mean_b + C1) * (spread("aa", "a", "a") + spread("bb", "b", "b") + C2))

    return F.aggregate(pairs, F.struct(*[F.lit(0.0).alias(k) for k in sums]), added, likeness)


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def jpeg_size(contents: pd.Series) -> pd.DataFrame:
    """Width and height that a JPEG file states; null for other files."""

    def size(content: bytes | None) -> tuple[int | None, int | None]:
        if content is None or content[:2] != b"\xff\xd8":
            return None, None
        at = 2
        while at + 9 < len(content):
            if content[at] != 0xFF:
                at += 1
                continue
            marker, length = content[at + 1], int.from_bytes(content[at + 2 : at + 4])
            if marker in (0xD9, 0xDA) or length < 2:
                break
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(content[at + 7 : at + 9]), int.from_bytes(content[at + 5 : at + 7])
            at += 2 + length
        return None, None

    return pd.DataFrame([size(c) for c in contents], columns=["width", "height"], dtype="Int64")
