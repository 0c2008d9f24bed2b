import hashlib
import random

from pyspark.sql import functions as F

from vellum.llm import simhash as S


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_edited_text_is_made_with_the_next_document(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 4)
    rng = random.Random(4)
    monkeypatch.setattr(S, "OVERSAMPLED", 2)
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(40)] + list(range(60))
    rows = [(i, "".join(rng.choice("ab é\U0001f600 \n") for _ in range(rng.randrange(40)))) for i in ids]
    docs = rows_of(spark, rows)
    got = {r.doc_id: r for r in S.edited(docs).collect()}
    assert len(got) == 100
    ordered = sorted(rows)
    for (i, text), (j, following) in zip(ordered, ordered[1:] + ordered[:1]):
        cut = len(text) // 4
        want = text[: len(text) - cut] + following[:cut]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        same = bin(int(got[i].fingerprint, 16) ^ int(got[j].fingerprint, 16)).count("1")
        assert abs(got[i].near_next - (1 - same / 64)) < 1e-9


def test_likeness_follows_the_edit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = S.edited(docs)
    assert found.count() == docs.count()
    mean = found.where("n_chars > 400").agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert mean[0] > 0.7 and mean[0] > mean[1] + 0.12
    prints = found.join(docs, "doc_id").groupBy("text").agg(F.countDistinct("fingerprint").alias("n"))
    assert prints.agg(F.max("n")).first()[0] == 1


def test_votes_as_by_brute_force(spark):
    texts = ["one two three two ONE", "", "word", "a b\tc\n\nd  e a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {r.k: r.bits & (2**64 - 1) for r in S.fingerprints(df, ["k"]).collect()}
    for k, text in enumerate(texts):
        words = text.lower().split()
        pairs = list(zip(words, [*words[1:], ""]))
        hashes = [r[0] & (2**64 - 1) for r in spark.createDataFrame(pairs, "a string, b string").select(F.xxhash64("a", "b")).collect()] if pairs else []
        weights = [min(16, len(a + b)) for a, b in pairs]
        want = sum(1 << i for i in range(64) if 2 * sum(w for h, w in zip(hashes, weights) if h >> i & 1) > sum(weights))
        assert got[k] == want


def test_search_finds_all_within_the_radius(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(7))) for b in base for _ in range(12)]
    signed = lambda x: x - 2**64 if x >> 63 else x
    table = spark.createDataFrame([(signed(p),) for p in prints] + [(None,)], "bits long")
    queries = spark.createDataFrame([(signed(b),) for b in base], "bits long")
    for radius, blocks in ((0, 2), (3, 6), (5, 7)):
        got = {(r.query, r.bits): r.rows for r in S.within_radius(queries, table, radius, blocks).collect()}
        want = {}
        for b in base:
            for p in prints:
                if bin(b ^ p).count("1") <= radius:
                    want[signed(b), signed(p)] = want.get((signed(b), signed(p)), 0) + 1
        assert got == want


def test_edges_of_the_input(spark):
    got = S.edited(rows_of(spark, [(3, "abcd efgh"), (3, "abcd efgh"), (3, "abcd efgh"), (None, "zzzz"), (None, None), (9, None)])).collect()
    assert len(got) == 6
    by = sorted((str(r.doc_id), r.n_chars, r.near_next) for r in got)
    assert [x[:2] for x in by] == [("3", 9), ("3", 9), ("3", 9), ("9", 0), ("None", 0), ("None", 4)]
    assert {r.fingerprint for r in got if r.n_chars == 0} == {"0" * 16}
    one = S.edited(rows_of(spark, [(20, "only one here now")])).first()
    assert (one.near_next, one.n_within) == (1.0, 1)
    assert S.edited(rows_of(spark, [])).count() == 0


def test_buckets_follow_the_rows_and_not_the_ids(spark):
    docs = spark.range(20_000).selectExpr("id", "cast(id % 7 as string) as text").union(spark.createDataFrame([(10**18, "far")], "id long, text string"))
    sizes = [r["count"] for r in S.with_next(docs).groupBy("bucket").count().collect()]
    assert sum(sizes) == 20_001 and 40 < len(sizes) < 120 and max(sizes) < 2500
    same = spark.range(5_000).selectExpr("7L as id", "cast(id as string) as text")
    assert len(S.bucket_bounds(same)) > 10
    found = S.with_next(same).collect()
    assert sorted(r.next_text for r in found) == sorted(str(i) for i in range(5_000))


def test_ids_of_other_types(spark):
    words = spark.createDataFrame([("b", "b text"), ("a", "a text"), ("é", "last"), ("20", "first")], "doc_id string, text string")
    got = {r.doc_id: (r.edited_sha256, r.n_within) for r in S.edited(words).collect()}
    want = {"20": "firsa", "a": "a texb", "b": "b texl", "é": "lasf"}
    assert {k: v[0] for k, v in got.items()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}
    assert [k for k, v in got.items() if v[1]] == ["20"]
