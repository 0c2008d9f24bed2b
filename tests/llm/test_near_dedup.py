import random
import re

import pytest

from vellum.llm import near_dedup as N
from vellum.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(i, len(s), root(i), root(i) == i) for i, s in sets}


def variants(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(rng.randrange(30, 120))]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("seed, small", [(1, 32), (2, 1)])
def test_components_as_by_brute_force(spark, seed, small, monkeypatch):
    monkeypatch.setattr(N, "SMALL_BAND", small)  # 1: all in blocks
    monkeypatch.setattr(N, "BLOCK_OUTSIDE", 3)
    monkeypatch.setattr(N, "BLOCK_OTHERS", 7)
    monkeypatch.setattr(N, "SIGNED_OUTSIDE", 4)
    monkeypatch.setattr(N, "SIGNED_OTHERS", 9)
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    texts = [None, "", " \n\t", "One", "one", "a b", "A  b", "x " * 3000]
    for _ in range(25):
        texts += variants(rng, words, rng.randrange(1, 12), 6)
    chain = [rng.choice(words) for _ in range(60)]
    for i in range(30):  # neighbours are alike, the ends are not
        chain[2 * i] = "z%d" % i
        texts.append(" ".join(chain))
    texts += [texts[20]] * 40 + variants(rng, words, 120, 40)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "n", "b") for i, t in rows], "doc_id long, text string, n string, bands string").repartition(5)
    got = {tuple(r) for r in N.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_edges_of_the_input(spark):
    docs = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (None, "q r s"), (9, "A b\nc")], "doc_id long, text string")
    got = sorted(map(tuple, N.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 1, 5, True), (5, 1, 5, True), (None, 1, 5, False), (None, 1, None, True), (9, 1, 5, False)], key=str)
    assert N.near_duplicates(docs.where("false")).count() == 0


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    rng = random.Random(8)
    say = lambda: " ".join("w%d" % rng.randrange(10**6) for _ in range(40))
    a, b, c = say(), say(), say()
    rows = [(5, a), (5, b), (5, b), (3, a + " end"), (7, b + " end"), (None, c), (9, c + " end"), (None, a + " end"), (5, None), (4, c)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key string").repartition(3)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in N.near_duplicates(docs).collect()), key=str)
    want = [(5, 3, False), (5, 5, True), (5, 5, True), (3, 3, True), (7, 5, False), (None, 4, False), (9, 4, False), (None, 3, False), (5, 5, True), (4, 4, True)]
    assert got == sorted(want, key=str)
    left = N.without_copies(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(5, b), (5, b), (3, a + " end"), (5, None), (4, c)], key=str)


def test_estimate_is_corrected_for_chance(spark):
    rng = random.Random(0)
    base = ["w%d" % i for i in range(1000)]
    other = base[:700] + ["v%d" % rng.randrange(10**6) for _ in range(300)]
    rows = N.signatures(spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other))], "doc_id long, text string"))
    a, b = rows.where("id = 1").select(rows.bits.alias("x")), rows.where("id = 2").select(rows.bits.alias("y"))
    found = a.crossJoin(b).select(N.estimate(a.x, b.y)).first()[0]
    true = len(shingles(" ".join(base)) & shingles(" ".join(other))) / len(shingles(" ".join(base)) | shingles(" ".join(other)))
    assert abs(found - true) < 0.2


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_members_without_a_likely_partner_move_no_text(spark):
    rng = random.Random(5)
    say = lambda n: " ".join("w%d" % rng.randrange(10**6) for _ in range(n))
    common = say(25)
    texts = [f"{common} {say(60)}" for _ in range(50)]
    texts += [texts[7] + " end", texts[9] + " end"]
    signed = N.signatures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = signed.selectExpr("1L as band", "id", "id as label", "id = 0 as inside", "n", "bits", "bands", "52L as size", "51L as outside")
    got = {(r.id, r.size, r.outside) for r in N.with_likely_partners(rows).collect()}
    assert got == {(7, 4, 4), (9, 4, 4), (50, 4, 4), (51, 4, 4)}
