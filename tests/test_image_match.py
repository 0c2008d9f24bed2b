import math
import random
import time

import numpy as np

from vellum.operators import image_match as M
from vellum.plans import records


def crop(picture):
    h, w = len(picture), len(picture[0])
    dark = [(y, x) for y in range(h) for x in range(w) if picture[y][x] < 245]
    if not dark:
        return picture
    ys, xs = [p[0] for p in dark], [p[1] for p in dark]
    return [row[max(0, min(xs) - 2) : max(xs) + 3] for row in picture[max(0, min(ys) - 2) : max(ys) + 3]]


def mean(picture, width, height):
    h, w = len(picture), len(picture[0])
    part = lambda i, n, side: [(k, min((i + 1) * n / side, k + 1) - max(i * n / side, k)) for k in range(int(i * n / side), min(n, math.ceil((i + 1) * n / side)))]
    out = []
    for y in range(height):
        rows = part(y, h, height)
        for x in range(width):
            columns = part(x, w, width)
            total = sum(a * b * picture[j][i] for j, a in rows for i, b in columns)
            out.append(int(total * width * height / (w * h) + 0.5 + 1e-9))
    return out


def plain(picture, rotation):
    picture = crop(np.rot90(np.array(picture), -rotation // 90).tolist())
    small, square, large = mean(picture, 17, 16), mean(picture, 16, 16), mean(picture, 128, 128)
    dhash = [small[17 * y + x] > small[17 * y + x + 1] for y in range(16) for x in range(16)]
    wave = lambda u, x: math.cos((2 * x + 1) * u * math.pi / 32)
    low = [sum(square[16 * y + x] * wave(u, x) * wave(v, y) for y in range(16) for x in range(16)) for v in range(8) for u in range(8)][1:]
    phash = [v > sorted(low)[31] for v in low]
    best, most = 0, 0.0
    for t in range(256):
        dark = [v for v in large if v <= t]
        light = [v for v in large if v > t]
        if dark and light and (between := len(dark) * len(light) * (sum(dark) / len(dark) - sum(light) / len(light)) ** 2) > most * (1 + 1e-12):
            best, most = t, between
    return dhash, phash, [255 * (v > best) for v in large]


def likeness(a, b):
    hashes = 1 - (sum(x != y for x, y in zip(a[0], b[0])) / 256 + sum(x != y for x, y in zip(a[1], b[1])) / 63) / 2
    x, y = np.array(a[2], float), np.array(b[2], float)
    cov = np.cov(x, y)
    ssim = (2 * x.mean() * y.mean() + 6.5025) * (2 * cov[0, 1] + 58.5225) / ((x.mean() ** 2 + y.mean() ** 2 + 6.5025) * (cov[0, 0] + cov[1, 1] + 58.5225))
    return hashes, 0.2 * hashes + 0.5 * (x == y).mean() + 0.3 * ssim


def brute(figure, drawings):
    for name, picture, digest in drawings:
        if digest == figure[2]:
            return name, 0, "sha256", 1.0
    own = plain(figure[1], 0)
    scored = [(name, rotation, *likeness(own, plain(picture, rotation))) for name, picture, _ in drawings for rotation in (0, 90, 180, 270)]
    top = sorted(scored, key=lambda r: -r[2])[:5]
    best = max(top, key=lambda r: r[3]) if top else None
    return (best[0], best[1], "hash-top5-binary-structure", best[3]) if best and best[3] >= 0.75 else None


def sketch(rng, h, w):
    picture = [[255] * w for _ in range(h)]
    for _ in range(rng.randrange(2, 6)):
        y, x, value = rng.randrange(h - 3), rng.randrange(w - 3), rng.randrange(0, 240)
        for j in range(y, min(h, y + rng.randrange(3, 14))):
            for i in range(x, min(w, x + rng.randrange(3, 14))):
                picture[j][i] = value
    return picture


def row(patent, place, name, abstract, picture, digest):
    return patent, place, name, abstract, digest, len(picture[0]), len(picture), bytearray(v for line in picture for v in line)


SCHEMA = "patent int, place int, file_name string, is_abstract boolean, content_hash string, width int, height int, pixels binary"


def test_same_matches_as_by_plain_loops(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for patent in range(9):
        figure = sketch(rng, rng.randrange(20, 34), rng.randrange(20, 40))
        drawings = [("D%d.tif" % k, sketch(rng, 24, 30), "h%d" % rng.randrange(10**6)) for k in range(2)]
        if patent % 3 == 0:
            noisy = [[min(255, max(0, v + rng.randrange(-9, 9))) for v in line] for line in np.rot90(np.array(figure), patent).tolist()]
            drawings.insert(1, ("T.tif", noisy, "t"))
        if patent == 4:
            drawings.append(("same.tif", sketch(rng, 9, 9), "own4"))
        rows.append(row(patent, 0, "A.tif", True, figure, f"own{patent}"))
        rows += [row(patent, k + 1, name, False, picture, digest) for k, (name, picture, digest) in enumerate(drawings)]
        rows.append(row(patent, 9, "x/a.TIF", False, figure, "of the figure's name"))
        want[patent] = brute(("A.tif", figure, f"own{patent}"), drawings)
    got = {r.patent: tuple(r)[2:] for r in M.matches(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items() if v}
    assert all(abs(got[k][3] - v[3]) < 1e-9 for k, v in want.items() if v) and {0, 3, 4, 6} <= set(got)


def test_edges_of_the_input(spark):
    white = [[255] * 8 for _ in range(6)]
    rows = [row(1, 0, "f", True, white, "a"), row(1, 1, "d", False, white, "b"), row(2, 0, "f", True, white, "a"), row(3, 1, "d", False, white, "a")]
    rows += [(4, 0, "f", True, "x", 5, 5, None), (4, 1, "d", False, "x", None, None, None), (5, 0, "f", True, None, 5, 5, bytearray(7)), (5, 1, "d", False, None, 5, 5, bytearray(25))]
    images = spark.createDataFrame(rows, SCHEMA)
    got = {r.patent: (r.drawing_file_name, r.method, r.score) for r in M.matches(images).collect()}
    assert got == {1: ("d", "hash-top5-binary-structure", 1.0), 4: ("d", "sha256", 1.0)}
    shown = {(r.patent, r.file_name): (r.canonical_file_name, r.display_rotation, r.match_score) for r in M.with_canonical(images, M.matches(images)).collect()}
    assert shown[1, "f"] == ("d", 0, 1.0) and shown[1, "d"] == ("d", 0, None) and shown[5, "f"] == ("f", 0, None) and len(shown) == len(rows)
    assert M.matches(images.where("false")).count() == 0


def test_time_is_linear_in_pixels():
    rng = np.random.default_rng(1)
    taken = []
    for side in (512, 1024):
        stack = rng.integers(0, 256, (4, side, side)).astype(np.uint8)
        began = time.process_time()
        M.features(stack)
        taken.append(time.process_time() - began)
    assert taken[1] < 10 * taken[0] + 0.2


def test_query_finds_the_turned_figures(spark):
    rows = records.image_matches(spark, "/root/testdata/sf0.001").collect()
    figures = [r for r in rows if r.file_name == "figure.TIF"]
    matched = [r for r in figures if r.match_method]
    assert len(figures) == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count() and len(matched) > 0.9 * len(figures)
    assert all(r.canonical_file_name == "same.TIF" and r.match_score == 1 for r in figures if r.patent % 5 == 0)
    turned = [r for r in matched if r.canonical_file_name == "turned.TIF"]
    assert turned and all(r.match_score > 0.99 for r in turned)


def test_a_turned_picture_has_the_features_of_the_picture_turned():
    rng = np.random.default_rng(3)
    for shape in ((3, 40, 27), (3, 5, 133), (3, 150, 141)):
        stack = np.where(rng.random(shape) < 0.1, rng.integers(0, 256, shape), 255).astype(np.uint8)
        stack[0] = 255
        found = M.turned_features(stack)
        for i, rotation in enumerate(M.ROTATIONS):
            turned = M.features(np.ascontiguousarray(np.rot90(stack, -rotation // 90, axes=(1, 2))))
            assert all((part[:, i].reshape(3, -1) == own.reshape(3, -1)).all() for part, own in zip(found, turned))
