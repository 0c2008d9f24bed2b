"""Hard negatives: rows of another label that are close to an anchor, but not as close as its positives.

A vector's components become whole numbers, floor(256 * x), and a score is their inner product. An anchor is a row whose id is
divisible by ``anchor_step``; its positives are the ``POSITIVES`` best other rows of its label, and for each of them its
negatives are the ``NEGATIVES`` best rows of other labels whose score is between ``LEAST`` and ``MOST`` hundredths of the positive's.

The search is exact, by an orthogonal rotation:

1. The principal axes of a bounded sample of rows (``FIT_ROWS``) rotate all vectors, so that the leading components
   hold most of a product. The rotation changes no product; a poor one only prunes less.
2. Of each pair the product of the leading components is taken first. The rest is at most the product of the two residual
   norms; with a slack for rounding that gives an upper and a lower bound. A pair that can neither reach the anchor's worst best
   row so far nor fall between its limits is discarded, the others go on to more components.
3. What survives all cuts is scored anew in whole numbers.

Anchors go out in groups of ``GROUP`` at most, and each group is held against all rows where these lie, block by block; a task
sends its best rows of each anchor only. Limits to start from come from a bounded sample of rows: the k-th best of some rows
is never above the k-th best of all. So nothing but the best rows is shuffled, and no pairs are written out.

Rows with a null label, a null vector or a component that is null, NaN or infinite take no part. Shorter vectors are
filled up with zeros; an empty one is all zeros. Higher scores come first, ties by the smaller id (no id last), then by the row;
rows that repeat an id or all values are rows of their own. A row without an id is no anchor. Vectors
so long that scores do not fit in a long (2**59 or more) are refused with a ``ValueError``. Other columns are not read,
whatever their names; without rows or anchors there are no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.store import shared_folder, stored

#: Best rows of the same label; rows of another that are returned for each; limits of their score in hundredths of the positive's.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 10, 30, 90
#: Anchors that go out at once; anchors and pairs that a task works on at once; candidates that it holds before it keeps the best.
GROUP, TILE, PAIRS, HELD = 8192, 512, 1 << 14, 1 << 18
#: Rows that the axes are fitted on, and that the limits to start from are found among.
FIT_ROWS, SEED_ROWS = 4096, 4096
#: Shares of the components after which pairs are discarded.
CUTS = (0.125, 0.25, 0.5, 1.0)
#: What rounding may add to a product of vectors, by the product of their lengths, and besides.
SLACK, LEAST_SLACK = 1e-9, 1e-6

_NEVER = 1 << 62
_FOUND = "anchor long, target int, id long, row long, score long"


@dataclass
class Anchors:
    """A group of anchors with the axes, and what is looked for: ``best`` rows of each target, a range of scores of each anchor."""

    axes: np.ndarray
    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    same: bool
    best: int
    low: np.ndarray
    high: np.ndarray
    floors: np.ndarray


def whole_vectors(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(id, label, vector, row) of the rows that take part, stored."""
    vector = table[vector_column].cast("array<double>")
    rows = table.select(table[id_column].cast("long").alias("id"), table[label_column].cast("long").alias("label"), vector.alias("vector"))
    real = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & real)
    return stored(rows.select("id", "label", F.transform("vector", lambda x: F.floor(x * 256)).alias("vector"), F.monotonically_increasing_id().alias("row")), "vectors")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of longs as the rows of a matrix, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def principal_axes(rows: DataFrame, width: int) -> np.ndarray:
    """The axes of a sample of ``rows``, chosen by a hash, by falling share of their products."""
    sample = rows.select("vector", F.xxhash64("row").alias("hash")).orderBy("hash").limit(FIT_ROWS).toArrow()
    some = matrix(sample["vector"], width).astype(float)
    return np.ascontiguousarray(np.linalg.eigh(some.T @ some)[1][:, ::-1])


def rotated(vectors: np.ndarray, axes: np.ndarray, cuts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors on the axes, the norms of what is behind each cut, and their whole norms."""
    on = vectors.astype(float) @ axes
    squares = np.cumsum((on * on)[:, ::-1], axis=1)[:, ::-1]
    rest = np.stack([squares[:, c] if c < on.shape[1] else np.zeros(len(on)) for c in cuts], axis=1)
    return on, np.sqrt(rest), np.sqrt(squares[:, 0])


def best_rows(found: list[np.ndarray], best: int) -> list[np.ndarray]:
    """The ``best`` of each target of (target, score, unnamed, id, row)."""
    target, score, unnamed, ids, row = found
    order = np.lexsort((row, ids, unnamed, -score, target))
    target = target[order]
    first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, np.int64)
    place = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
    return [x[order[place < best]] for x in found]


def search(rows: DataFrame, wanted: Anchors) -> DataFrame:
    """(anchor, target, id, row, score): of the tasks of ``rows`` the best of each target of each anchor; anchors are given by their rows."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)  # ``GROUP`` anchors

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        width = a.axes.shape[0]
        cuts = sorted({max(1, int(np.ceil(c * width))) for c in CUTS})
        on_anchor, rest_anchor, norm_anchor = rotated(a.vectors, a.axes, cuts)
        targets = a.low.shape[1]
        floors = np.maximum(a.low, a.floors)
        kept, waiting, held = [np.zeros(0, np.int64)] * 5, [], 0

        def settle() -> None:
            nonlocal kept, waiting, held
            kept, waiting, held = best_rows([np.concatenate(x) for x in zip(kept, *waiting)], a.best), [], 0
            last = np.flatnonzero(np.bincount(kept[0], minlength=floors.size) >= a.best)
            ends = np.searchsorted(kept[0], last, side="right") - 1
            floors.reshape(-1)[last] = np.maximum(floors.reshape(-1)[last], kept[1][ends])

        for batch in source:
            if not batch.num_rows:
                continue
            labels, row = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 3))
            unnamed = batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = batch.column(0).fill_null(0).to_numpy()
            own = matrix(batch.column(2), width)
            on, rest, norm = rotated(own, a.axes, cuts)
            for tile in range(0, len(a.rows), TILE):
                part = slice(tile, tile + TILE)
                # a target that is not there has a low limit above its high one
                real = a.low[part] <= a.high[part]
                least = np.where(real, floors[part], _NEVER).min(axis=1).astype(float)
                most = np.where(real, a.high[part], -_NEVER).max(axis=1).astype(float)
                product = on[:, : cuts[0]] @ on_anchor[part, : cuts[0]].T
                reach = rest[:, :1] * rest_anchor[part, 0] + SLACK * norm[:, None] * norm_anchor[part] + LEAST_SLACK
                open_ = ((labels[:, None] == a.labels[part]) == a.same) & (product + reach >= least) & (product - reach <= most)
                i, j = np.nonzero(open_ & (row[:, None] != a.rows[part]))
                for at in range(0, len(i), PAIRS):
                    x, y = i[at : at + PAIRS], j[at : at + PAIRS]
                    partial = product[x, y]
                    for before, cut, k in zip(cuts, cuts[1:], range(1, len(cuts))):
                        partial = partial + np.einsum("nd,nd->n", on[x, before:cut], on_anchor[tile + y, before:cut])
                        reach = rest[x, k] * rest_anchor[tile + y, k] + SLACK * norm[x] * norm_anchor[tile + y] + LEAST_SLACK
                        stay = (partial + reach >= least[y]) & (partial - reach <= most[y])
                        x, y, partial = x[stay], y[stay], partial[stay]
                    score = np.einsum("nd,nd->n", own[x], a.vectors[tile + y])
                    for t in range(targets):
                        hit = np.flatnonzero((score >= floors[tile + y, t]) & (score <= a.high[tile + y, t]))
                        waiting.append([(tile + y[hit]) * targets + t, score[hit], unnamed[x[hit]], ids[x[hit]], row[x[hit]]])
                        held += len(hit)
                    if held >= HELD + len(kept[0]):
                        settle()
        settle()
        target, score, unnamed, ids, row = kept
        columns = [pa.array(a.rows[target // targets], pa.int64()), pa.array(target % targets, pa.int32()), pa.array(ids, pa.int64(), mask=unnamed.astype(bool)), pa.array(row, pa.int64()), pa.array(score, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["anchor", "target", "id", "row", "score"])

    ranked = W.partitionBy("anchor", "target").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    found = rows.select("id", "label", "vector", "row").mapInArrow(batches, _FOUND)
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= wanted.best)


def floors_of(found: DataFrame, wanted: Anchors) -> np.ndarray:
    """The worst score of each target that has all of its best rows among ``found``."""
    last = found.where(F.col("rank") == wanted.best).select("anchor", "target", "score").toArrow()  # a row for each target
    out = wanted.floors.copy()
    place = np.searchsorted(wanted.rows, last["anchor"].to_numpy())
    out[place, last["target"].to_numpy()] = last["score"].to_numpy()
    return out


def seeded(rows: DataFrame, seeds: DataFrame, wanted: Anchors, name: str) -> DataFrame:
    """The best of all ``rows``, with limits to start from found among ``seeds``, some of them; stored."""
    wanted.floors = floors_of(search(seeds, wanted), wanted)
    return stored(search(rows, wanted), name)


def mine(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", anchor_step: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive."""
    spark = table.sparkSession
    rows = whole_vectors(table, id_column, vector_column, label_column)
    length = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    anchor = F.col("id") % anchor_step == 0
    n, n_anchors, width, longest = rows.agg(F.count("*"), F.count_if(anchor), F.max(F.size("vector")), F.max(length)).first()
    if n and longest >= 2.0**59:
        raise ValueError("vectors are so long that their products do not fit in a long")
    path = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    if n_anchors:
        axes = principal_axes(rows, max(width, 1))
        seeds = rows.where(F.pmod(F.xxhash64("row", F.lit("seed")), F.lit(max(1, n // SEED_ROWS))) == 0)
        groups = -(-n_anchors // GROUP)
        for k in range(groups):
            own = rows.where(anchor & (F.pmod(F.xxhash64("row", F.lit("group")), F.lit(groups)) == k)).orderBy("row").toArrow()  # about ``GROUP`` rows
            if len(own):
                _mine_group(rows, seeds, own, axes).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _mine_group(rows: DataFrame, seeds: DataFrame, own: pa.Table, axes: np.ndarray) -> DataFrame:
    ids, labels, anchors = (own[c].to_numpy() for c in ("id", "label", "row"))
    vectors, n = matrix(own["vector"], axes.shape[0]), len(anchors)
    limits = lambda value, targets: np.full((n, targets), value, np.int64)
    wanted = Anchors(axes, anchors, ids, labels, vectors, True, POSITIVES, limits(-_NEVER, 1), limits(_NEVER - 1, 1), limits(-_NEVER, 1))
    near = seeded(rows, seeds, wanted, "positives")
    found = near.select("anchor", "rank", "score").toArrow()  # ``POSITIVES`` of each anchor
    score = found["score"].to_numpy()
    place = np.searchsorted(anchors, found["anchor"].to_numpy()), found["rank"].to_numpy() - 1
    low, high = limits(_NEVER, POSITIVES), limits(-_NEVER, POSITIVES)
    low[place], high[place] = -(-score * LEAST // 100), score * MOST // 100
    wanted = Anchors(axes, anchors, ids, labels, vectors, False, NEGATIVES, low, high, limits(-_NEVER, POSITIVES))
    far = seeded(rows, seeds, wanted, "candidates")
    positive = near.select("anchor", (F.col("rank") - 1).alias("target"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = rows.sparkSession.createDataFrame(pa.table({"anchor": anchors, "anchor_id": ids}))  # ``GROUP`` rows
    both = positive.join(far, ["anchor", "target"]).join(names, "anchor")
    return both.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
