import random
import re
from collections import Counter

import pytest

from vellum.llm import divergence as D


def brute(rows, least=10, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    split = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for lang, source, text in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        docs = Counter(t for g, _, words in split if g == lang for t in set(words))
        kept = {t for t, n in docs.items() if n >= least}
        count = {}
        for g, source, words in split:
            if g == lang:
                count.setdefault(source, Counter()).update(t for t in words if t in kept)
        whole = sum(count.values(), Counter())
        price = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        prices, q = {s: price(c) for s, c in count.items()}, price(whole)
        for s, p in prices.items():
            pairs = [(-sum(f(p[t], r[t]) for t in kept), o.encode(), o) for o, r in prices.items() if o != s]
            terms = [(-f(p[t], q[t]), t.encode(), t) for t in kept if count[s][t] and p[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(found)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, lang, source, text, "t", 1) for k, (lang, source, text) in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, n int").repartition(5)


@pytest.mark.parametrize("counted", [1 << 21, 64])
def test_same_rows_as_by_brute_force(spark, counted, monkeypatch):
    monkeypatch.setattr(D, "COUNTED", counted)
    rng = random.Random(2)
    words = ["w" + chr(97 + i) for i in range(26)] + ["W" + chr(65 + i) for i in range(26)] + ["É", "é", "straße", "日本", "\U0001f600", "é", "x9y", "it's", "\x00", "\x7f", "\u0085", " ", "{", "@", "[", "`"]
    rows = []
    for _ in range(500):
        lang = rng.choices(["en", "de", "", None, "few"], [9, 4, 1, 1, 0.1])[0]
        source = rng.choices(["hot", "b", "", None, "Ünder", "z"], [9, 1, 1, 1, 2, 1])[0]
        some = rng.sample(words, 12)
        rows.append((lang, source, rng.choice([None, "", " ", "12 3", *[" ".join(rng.choices(some, k=rng.randrange(1, 30))) for _ in range(9)]])))
    rows += [("en", "empty", None), ("en", "other", ""), ("new", "a", "one two"), ("new", "b", None), ("alone", "a", "x")] + rows[:20]
    rows.append(("en", "long", "wa WB " * 30_000))
    got = [tuple(r) for r in D.audit(frame(spark, rows)).collect()]
    want = brute(rows)
    assert len(got) == len(want) and set(got) == want


def test_least_documents_and_empty_tables(spark):
    rows = [("en", s, "same other " + s) for s in "abc" for _ in range(2)]
    got = {tuple(r) for r in D.audit(frame(spark, rows), least_docs=2, top_terms=1).collect()}
    assert got == brute(rows, 2, 1) and len(got) == 9
    assert D.audit(frame(spark, rows).where("false")).count() == 0


def test_prices_of_huge_counts_are_exact(spark):
    n, total, kept = 10**18 + 7, 9 * 10**18 + 1, 10**9
    row = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long").select(D.price("n", "total", "kept").alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (total + 2 * kept)
