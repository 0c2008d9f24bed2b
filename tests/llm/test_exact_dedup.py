import hashlib
import random
import re

import numpy as np
import pytest

from vellum.llm import exact_dedup as E
from vellum.llm import filters


def brute(rows):
    groups = {}
    for k, (i, text) in enumerate(rows):
        plain = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(plain, []).append((-len(text or ""), i is None, i or 0, k))
    out = [None] * len(rows)
    for plain, members in groups.items():
        first = min(members)
        for m in members:
            out[m[3]] = (rows[m[3]][0], rows[first[3]][0], len(members), m[:3] == first[:3], hashlib.sha256(plain.encode()).hexdigest())
    return out


@pytest.mark.parametrize("bits", [None, 1 << 16])
def test_groups_as_by_brute_force(spark, bits, monkeypatch):
    if bits:  # a filter far too small: nearly all rows pass it, and the result is the same
        monkeypatch.setattr(filters, "FILTER_BITS", bits)
        monkeypatch.setattr(filters, "HELD_KEYS", 50)
    rng = random.Random(3)
    texts = [None, "", " \t\n\x0b\x0c\r", " ", "a b", "ab", "a b", "Ab", "é", "é", "\U0001f600 \U0001f600", "\U0001f600\U0001f600"]
    texts += ["".join(rng.choice("ab \n") for _ in range(rng.randrange(1, 9))) for _ in range(900)] + ["once %d" % i for i in range(3000)] + ["many"] * 700 + ["x " * 200_000, "x" * 200_000]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "z", True) for i, t in rows], "doc_id long, text string, digest string, kept boolean").repartition(7)
    got = sorted(map(tuple, E.duplicates(docs).collect()))
    assert got == sorted(brute(rows))


def test_edges_of_the_input(spark):
    rows = [(5, "a b"), (5, "a b"), (5, "c"), (None, "a  b c"), (None, "abc"), (None, "q"), (7, "ab "), (2, "ab"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = E.duplicates(docs).collect()
    kept = sorted(((r.doc_id, r.keep_id, r.group_size) for r in got if r.kept), key=str)
    # of two rows that are the same in all, one stays
    assert kept == sorted([(5, 5, 4), (5, 5, 1), (None, None, 2), (None, None, 1), (9, 9, 1)], key=str)
    assert len(got) == len(rows)
    assert E.duplicates(docs.where("false")).count() == 0
    words = spark.createDataFrame([("b", "x"), ("a", "x "), ("c", " x")], "doc_id string, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in E.duplicates(words).collect()} == {("b", "a", False), ("a", "a", True), ("c", "a", False)}


def test_rows_that_stay_have_all_columns(spark):
    rows = [(i, f"text {i % 40}" + " " * (i % 3), f"d{i}", i) for i in range(200)] + [(None, None, None, None), (3, "", "n", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, may long").repartition(5)
    got = {tuple(r) for r in E.without_duplicates(docs).collect()}
    flags = brute([r[:2] for r in rows])
    want = {r for r, f in zip(rows, flags) if f[3]}
    assert got == want and len(got) == 41
    assert E.without_duplicates(docs).columns == docs.columns
    assert E.without_duplicates(docs.where("false")).count() == 0


def test_only_rows_that_may_be_repeated_are_shuffled(spark):
    keys = spark.range(20_000).selectExpr("xxhash64(id) as key").union(spark.range(50).selectExpr("xxhash64(id) as key"))
    held = filters.repeated_filter(keys, "key")
    every = np.array([r.key for r in keys.select("key").distinct().collect()], np.int64).view(np.uint64)
    twice = np.array([r.key for r in spark.range(50).selectExpr("xxhash64(id) as key").collect()], np.int64).view(np.uint64)
    assert held.has(twice).all() and held.has(every).mean() < 0.02
    assert not filters.repeated_filter(keys.where("false"), "key").words.any()
