import math
import random

import pytest

from vellum.llm import hard_negatives as H


def brute(rows, step):
    width = max((len(v) for _, v, _ in rows if v), default=0)
    real = [(i, [math.floor(256 * x) for x in v] + [0] * (width - len(v)), c) for i, v, c in rows if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for k, (i, v, c) in enumerate(real):
        if i is None or i % step:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, d) for m, (j, w, d) in enumerate(real) if m != k]
        for s, p, _ in sorted((r for r in scored if r[2] == c), key=order)[:5]:
            far = sorted((r for r in scored if r[2] != c and 30 * s <= 100 * r[0] <= 90 * s), key=order)[:10]
            out += [(i, p, n + 1, j, s, t) for n, (t, j, _) in enumerate(far)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, "x", 1) for i, v, c in rows], "vec_id long, embedding array<float>, label int, row string, vector int").repartition(5)


def as_float(x):
    return float(__import__("numpy").float32(x))


@pytest.mark.parametrize("seed, held", [(1, 1 << 18), (2, 40)])
def test_same_rows_as_by_brute_force(spark, seed, held, monkeypatch):
    for name, value in {"HELD": held, "TILE": 7, "PAIRS": 50, "GROUP": 9, "SEED_ROWS": 60, "FIT_ROWS": 50}.items():
        monkeypatch.setattr(H, name, value)
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(20)] for _ in range(4)]
    rows = [(i, [as_float(x + rng.gauss(0, 0.1)) for x in centres[rng.randrange(4)]], rng.randrange(4)) for i in range(900)]
    rows += [(i, rows[i % 50][1], rows[i % 50][2]) for i in range(900, 960)]  # ties
    rows += [(10, rows[10][1], 2), (20, [as_float(0.1)] * 3, 1), (30, [], 1), (None, rows[3][1], 0), (960, None, 1), (970, [1.0, None], 1), (980, [math.nan] * 20, 2), (990, [math.inf], 2), (1000, rows[4][1], None)]
    got = sorted(map(tuple, H.mine(frame(spark, rows), anchor_step=10).collect()), key=str)
    want = sorted(brute(rows, 10), key=str)
    assert len(want) > 3000 and got == want


def test_long_vectors_and_small_tables(spark):
    rng = random.Random(5)
    rows = [(i, [as_float(rng.gauss(0, 10.0 ** rng.randrange(-3, 5))) for _ in range(9)], i % 2) for i in range(120)]
    assert sorted(map(tuple, H.mine(frame(spark, rows), anchor_step=3).collect())) == sorted(brute(rows, 3))
    with pytest.raises(ValueError):
        H.mine(frame(spark, [(0, [1e30], 0), (1, [1.0], 0)]))
    assert H.mine(frame(spark, rows).where("false")).count() == 0
    assert H.mine(frame(spark, rows[1:3])).count() == 0
    one = H.mine(frame(spark, [(100, [1.0], 0)]))
    assert one.count() == 0 and one.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    zero = [(0, [0.0, 0.0], 1), (1, [3.0, 0.0], 1), (2, [1.0, 1.0], 2), (3, [-1.0, 0.0], 2)]
    assert sorted(map(tuple, H.mine(frame(spark, zero)).collect())) == sorted(brute(zero, 100)) == [(0, 1, 1, 2, 0, 0), (0, 1, 2, 3, 0, 0)]


def test_most_pairs_are_discarded_before_the_last_cut(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    axes = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    vectors = rng.normal(size=(4000, 64)) * np.geomspace(200, 0.5, 64) @ axes
    on, rest, _ = H.rotated(vectors.astype(np.int64), np.linalg.eigh(vectors.T @ vectors)[1][:, ::-1], [8, 64])
    exact, bound = on @ on[:40].T, on[:, :8] @ on[:40, :8].T + rest[:, :1] * rest[:40, 0]
    fifth = np.sort(exact, axis=0)[-5]
    assert (bound >= exact - 1e-6).all() and (bound >= fifth).mean() < 0.1
