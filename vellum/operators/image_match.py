"""The drawing that shows the same as the figure of a patent's abstract, by pictures given as gray pixels.

1. A picture is cropped to what is darker than white, with a margin. Area means of the crop give a difference hash and a frequency hash,
   and a picture of 128 by 128 in black and white, in four rotations. Means are taken once, as those of a turned picture are the means turned.
   Pictures of the same size are one array, and crop and mean are one product with matrices of weights, so the time is linear in pixels.
2. The images of a patent meet once, by a window that gives each drawing the figure; a task takes the features of both and hands on in how many bits
   they differ or agree, so neither pixels nor bits are shuffled again. The five best by both hashes go on, and of these the best by hashes, pixels
   and structure counts if it reaches 0.75.

A drawing of equal content is the match, of several the first, with score 1 and no rotation. A patent without a figure or without drawings has no
match. A picture without pixels, or with fewer than its size says, takes part by its content only; a picture that is white all over is not
cropped. Of equal scores the earlier drawing and the smaller rotation count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.text import image_key
from vellum.operators.image_features import BINARY_SIDE, C1, C2, DHASH_WIDTH, HASH_SIDE, thresholds

#: What is white, the margin of a crop, rotations (clockwise), candidates that go on, weights of hashes, pixels and structure, and the least score.
WHITE, MARGIN, ROTATIONS, BEST, WEIGHTS, LEAST = 245, 2, (0, 90, 180, 270), 5, (0.2, 0.5, 0.3), 0.75
#: Bits of the hashes, pixels of the black and white picture.
DHASH_BITS, PHASH_BITS, PIXELS = 256, 63, BINARY_SIDE * BINARY_SIDE
#: Numbers in one array of pictures, and pairs of pictures that are compared at a time: arrays stay within a core's cache.
STACKED, AT_ONCE = 1 << 17, 256

_WAVES = np.cos((2 * np.arange(HASH_SIDE)[None, :] + 1) * np.arange(8)[:, None] * np.pi / (2 * HASH_SIDE))
_COUNTS = ("rotation", "dhash", "phash", "figure_ones", "ones", "both")


def crops(pictures: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last row, first and last column of the crop of each picture."""
    dark = pictures < WHITE
    edges = []
    for axis in (2, 1):
        some = dark.any(axis=axis)
        n = some.shape[1]
        first, last = some.argmax(axis=1), n - 1 - some[:, ::-1].argmax(axis=1)
        empty = ~some.any(axis=1)
        edges += [np.where(empty, 0, np.maximum(0, first - MARGIN)), np.where(empty, n - 1, np.minimum(n - 1, last + MARGIN))]
    return tuple(edges)


def area_weights(first: np.ndarray, last: np.ndarray, n: int, side: int) -> np.ndarray:
    """(pictures, side, n): the share that each of ``n`` pixels has in the mean of each of ``side`` equal parts of first..last."""
    length = (last - first + 1)[:, None] / side
    low = first[:, None] + np.arange(side) * length
    pixel = np.arange(n, dtype=float)
    shared = np.minimum((low + length)[:, :, None], pixel + 1)
    shared -= np.maximum(low[:, :, None], pixel)
    np.maximum(shared, 0, out=shared)
    shared /= length[:, :, None]
    return shared


def rounded(means: np.ndarray) -> np.ndarray:
    """Means of pixels as pixels."""
    means += 0.5 + 1e-9
    return means.astype(np.uint8)


def resized(pictures: np.ndarray, lying: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """The crops of pictures as rounded area means of 128 by 128 and 16 by 16, of 17 by 16 and, if ``lying``, of 16 by 17.

    A mean of 16 equal parts is one of eight means of 128.
    """
    crop, pictures = crops(pictures), pictures.astype(float)
    few = lambda x, axis: x.reshape(*x.shape[:axis], HASH_SIDE, -1, *x.shape[axis + 1 :]).mean(axis=axis + 1)
    weights = lambda axis, side: area_weights(*crop[2 * axis - 2 : 2 * axis], pictures.shape[axis], side)
    columns = weights(2, BINARY_SIDE)
    rows = weights(1, BINARY_SIDE) @ pictures
    large = rows @ columns.transpose(0, 2, 1)
    square, upright = few(few(large, 1), 2), few(rows, 1) @ weights(2, DHASH_WIDTH).transpose(0, 2, 1)
    turned = rounded(weights(1, DHASH_WIDTH) @ pictures @ few(columns, 1).transpose(0, 2, 1)) if lying else None
    return rounded(large), rounded(square), rounded(upright), turned


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of longs, the first bit the lowest."""
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def turned_features(pictures: np.ndarray, rotations: tuple[int, ...] = ROTATIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Difference hash, frequency hash and black and white pixels of pictures of one size, as bits in longs, for each rotation."""
    n = len(pictures)
    # a turned picture's 17 columns are 17 rows of the picture
    large, square, upright, lying = resized(pictures, any(r % 180 for r in rotations))
    light = large > thresholds(large.reshape(n, -1))[:, None, None]
    found = []
    for rotation in rotations:
        small, own, black = (np.ascontiguousarray(np.rot90(x, -rotation // 90, axes=(1, 2))) for x in (lying if rotation % 180 else upright, square, light))
        low = (_WAVES @ own @ _WAVES.T).reshape(n, -1)[:, 1:]
        phash = np.zeros((n, 64), bool)
        phash[:, :PHASH_BITS] = low > np.sort(low, axis=1)[:, PHASH_BITS // 2, None]
        found.append((packed((small[:, :, :-1] > small[:, :, 1:]).reshape(n, -1)), packed(phash), packed(black.reshape(n, -1))))
    return tuple(np.stack(x, axis=1) for x in zip(*found))


def features(pictures: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Difference hash, frequency hash and black and white pixels of pictures of one size, as bits in longs."""
    dhash, phash, black = turned_features(pictures, ROTATIONS[:1])
    return dhash[:, 0], phash[:, 0, 0], black[:, 0]


def fitting(width: pa.Array, height: pa.Array, pixels: pa.Array) -> np.ndarray:
    """Which pictures have as many pixels as their size says."""
    width, height, length = (c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (width, height, pc.binary_length(pixels)))
    return (length == width * height) & (length > 0)


def distinct_features(width: pa.Array, height: pa.Array, pixels: pa.Array, rotations: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Features of the pictures, which fit their sizes; of equal ones they are taken once."""
    shapes = np.stack([c.to_numpy(zero_copy_only=False) for c in (height, width, pixels.dictionary_encode().indices)])
    _, at, places = np.unique(shapes, axis=1, return_index=True, return_inverse=True)
    out = [np.empty((len(at), len(rotations), n), "<i8") for n in (DHASH_BITS // 64, 1, PIXELS // 64)]
    for h, w in sorted({(int(h), int(w)) for h, w in shapes[:2, at].T}):
        own = np.flatnonzero((shapes[0, at] == h) & (shapes[1, at] == w))
        step = max(1, STACKED // max(h * w, PIXELS))
        for some in (own[i : i + step] for i in range(0, len(own), step)):
            stack = np.stack([np.frombuffer(pixels[int(i)].as_buffer(), np.uint8).reshape(h, w) for i in at[some]])
            for whole, part in zip(out, turned_features(stack, rotations)):
                whole[some] = part
    return tuple(x[places.reshape(-1)] for x in out)


def compared(pairs: DataFrame, rotations: tuple[int, ...] = ROTATIONS) -> DataFrame:
    """The rows of pairs of pictures, (width, height, pixels) and (figure_width, figure_height, figure_pixels), once for each rotation of the first, with counts
    in place of the pictures: bits in which both hashes differ, light pixels of the figure, of the other, and of both. A pair of which one does not fit
    its size is one row without counts."""
    pictures = [f"{of}{c}" for of in ("", "figure_") for c in ("width", "height", "pixels")]
    others = [c for c in pairs.columns if c not in pictures]

    def counts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kept = batch.select(others)
        first, figure = ([batch.column(c) for c in side] for side in (pictures[:3], pictures[3:]))
        fits = fitting(*first) & fitting(*figure)
        missing = pa.array(np.flatnonzero(~fits))
        if len(missing):
            yield pa.RecordBatch.from_arrays([*kept.take(missing).columns, *[pa.nulls(len(missing), pa.int32())] * len(_COUNTS)], [*others, *_COUNTS])
        if fits.any():
            some = pa.array(np.flatnonzero(fits))
            a_dhash, a_phash, a_black = distinct_features(*[c.take(some) for c in figure], rotations=ROTATIONS[:1])
            dhash, phash, black = distinct_features(*[c.take(some) for c in first], rotations=rotations)
            ones = lambda bits: np.bitwise_count(bits.view("<u8")).sum(axis=2, dtype=np.int32)
            found = [np.broadcast_to(np.array(rotations, np.int32), phash.shape[:2]), ones(dhash ^ a_dhash), ones(phash ^ a_phash), np.broadcast_to(ones(a_black), phash.shape[:2]), ones(black), ones(black & a_black)]
            again = kept.take(pa.array(np.repeat(np.flatnonzero(fits), len(rotations))))
            yield pa.RecordBatch.from_arrays([*again.columns, *[pa.array(x.reshape(-1)) for x in found]], [*others, *_COUNTS])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, batch.num_rows, AT_ONCE):
                yield from counts(batch.slice(at, AT_ONCE))

    kinds = [f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in others] + [f"{c} int" for c in _COUNTS]
    return pairs.select(*others, *pictures).mapInArrow(batches, ", ".join(kinds))


def hash_score(dhash: Column, phash: Column) -> Column:
    """Likeness of two pictures by the numbers of bits in which their hashes differ."""
    return 1 - (dhash / DHASH_BITS + phash / PHASH_BITS) / 2


def structure_score(hashes: Column, a_ones: Column, b_ones: Column, both: Column, n: int = PIXELS) -> Column:
    """Likeness by hashes, by pixels and by structure, of pictures of ``n`` pixels 0 or 255 of which so many are light in each and in both."""
    agreement = (n - a_ones - b_ones + 2 * both) / n
    mean_a, mean_b = a_ones * 255 / n, b_ones * 255 / n
    spread = lambda light, x, y: 65025 * (light - x * y / n) / (n - 1)
    structure = (2 * mean_a * mean_b + C1) * (2 * spread(both, a_ones, b_ones) + C2)
    structure = structure / ((mean_a * mean_a + mean_b * mean_b + C1) * (spread(a_ones, a_ones, a_ones) + spread(b_ones, b_ones, b_ones) + C2))
    return WEIGHTS[0] * hashes + WEIGHTS[1] * agreement + WEIGHTS[2] * structure


def matches(images: DataFrame, key: str = "patent") -> DataFrame:
    """(key, abstract_file_name, drawing_file_name, rotation, method, score) of each patent whose figure of the abstract is one of its drawings.

    ``images`` has key, place (the order of drawings), file_name, is_abstract, content_hash, width, height and pixels, a byte each, row by row; of several
    figures of a patent the first counts. Drawings of the figure's own name are left out.
    """
    own, place = W.partitionBy(key), F.struct("place", "file_name")
    rows = images.where(F.col(key).isNotNull()).select(key, "place", "file_name", "is_abstract", "content_hash", "width", "height", "pixels")
    rows = rows.withColumn("figure", F.min_by(F.struct("file_name", "content_hash", "width", "height", "pixels"), F.when(F.col("is_abstract"), place)).over(own))
    rows = rows.where("not is_abstract").where(image_key(F.col("file_name")) != image_key(F.col("figure.file_name")))
    rows = rows.withColumn("same", F.min_by("file_name", F.when(F.col("content_hash") == F.col("figure.content_hash"), place)).over(own))
    # where a drawing is of equal content, no pictures are compared
    some = [F.when(F.col("same").isNull(), F.col(c)).alias(c.replace(".", "_")) for c in ("width", "height", "pixels", "figure.width", "figure.height", "figure.pixels")]
    pairs = compared(rows.select(key, "place", "file_name", "same", F.col("figure.file_name").alias("abstract_file_name"), *some))
    pairs = pairs.withColumn("hashes", hash_score(F.col("dhash"), F.col("phash")))
    order = [F.desc("hashes"), F.asc("place"), F.asc("file_name"), F.asc("rotation")]
    few = pairs.withColumn("rank", F.row_number().over(own.orderBy(*order))).where(F.col("rank") <= BEST)
    few = few.withColumn("score", structure_score(*[F.col(c) for c in ("hashes", "figure_ones", "ones", "both")]))
    first = F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("score"), "rank"))
    best = few.groupBy(key, "abstract_file_name").agg(F.min("same").alias("same"), F.min_by(F.struct("file_name", "rotation", "score"), first).alias("best"))
    is_same = F.col("same").isNotNull()
    either = lambda same, best, name: F.when(is_same, same).otherwise(best).alias(name)
    return best.where(is_same | (F.col("best.score") >= LEAST)).select(
        key, "abstract_file_name", either(F.col("same"), F.col("best.file_name"), "drawing_file_name"), either(F.lit(0), F.col("best.rotation"), "rotation"),
        either(F.lit("sha256"), F.lit("hash-top5-binary-structure"), "method"), either(F.lit(1.0), F.col("best.score"), "score"),
    )


def with_canonical(images: DataFrame, found: DataFrame, key: str = "patent") -> DataFrame:
    """``images`` with canonical_file_name, display_rotation, match_method, match_score and matched_file_name: a matched figure is shown as its drawing, turned; others are their own."""
    shown = found.select(key, F.col("abstract_file_name").alias("file_name"), F.col("drawing_file_name").alias("matched_file_name"), F.col("rotation").alias("turned"), F.col("method").alias("match_method"), F.col("score").alias("match_score"), F.lit(True).alias("is_abstract"))
    joined = images.join(shown, [key, "file_name", "is_abstract"], "left")
    joined = joined.withColumns({"canonical_file_name": F.coalesce("matched_file_name", "file_name"), "display_rotation": F.coalesce("turned", F.lit(0))})
    return joined.select(*[images[c] if c not in (key, "file_name", "is_abstract") else c for c in images.columns], "canonical_file_name", "display_rotation", "match_method", "match_score", "matched_file_name")
