import datetime

from pyspark.sql import functions as F

from vellum.operators import integrity as I
from vellum.operators import listing as L
from vellum.operators import merge as M
from vellum.operators import stats as S
from vellum.operators import vectors as V
from vellum.operators import whitelist as WL
from vellum.operators import image_features as IF
from vellum.operators import images as IM
from vellum.operators import writes as W
from vellum.operators import classification as CL


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_manifest(spark):
    lines = spark.createDataFrame([("a,b\\INNER.ZIP,762AE69",), ("x.zip,00000001",), ("gone.zip,2",), ("bad",)], "value string")
    expected = I.manifest_rows(lines)
    assert rows(expected) == [("INNER.ZIP", "0762AE69"), ("gone.zip", "00000002"), ("x.zip", "00000001")]
    actual = spark.createDataFrame([("inner.zip", "0762AE69"), ("x.zip", "00000003"), ("new.zip", "1")], "name string, actual string")
    assert [(r[0], r[3]) for r in rows(I.manifest_failures(expected, actual))] == [("gone.zip", "missing"), ("new.zip", "uncovered"), ("x.zip", "mismatch")]
    said = [r.line for r in I.report(I.manifest_failures(expected, actual)).collect()]
    assert sorted(said) == ["  - gone.zip: 文件不存在", "  - new.zip: ZIP 文件未出现在 CRC 清单中", "  - x.zip: CRC32 不匹配 (期望: 00000001, 实际: 00000003)"]
    opened = spark.createDataFrame([("inner.zip", "0762AE69", False), ("x.zip", "00000001", True), ("gone.zip", "00000002", True), ("readme.txt", "9", True)], "name string, actual string, opens boolean")
    assert [(r[0], r[3]) for r in rows(I.manifest_failures(expected, opened))] == [("INNER.ZIP", "damaged")]
    assert rows(I.empty_manifests(spark.createDataFrame([("a", "x"), ("a", ""), ("b", "p,1F")], "manifest string, value string"))) == [("a", "no entries")]


def test_split_archives(spark):
    parts = [("ok", 0, 5), ("ok", 1, 9), ("ok", 2, 9), ("hole", 0, 1), ("hole", 2, 1), ("main", 1, 1), ("zero", 0, 0), ("odd", 0, 1), ("odd", 1, 1), ("odd", 2, 2), ("single", 0, 3)]
    found = dict(rows(I.split_failures(spark.createDataFrame(parts, "base string, part int, size long"))))
    assert found == {"hole": "parts not in sequence", "main": "no main file", "zero": "empty part", "odd": "parts of unequal size"}


def test_upsert_policy(spark):
    old = spark.createDataFrame([("1", None, "t", "d", "keep"), ("2", "B", "t", "d", "keep")], "n string, kind string, title string, description string, pub string")
    new = spark.createDataFrame([("1", None, "T", None, "no"), ("3", "A", "T", "D", "P")], "n string, kind string, title string, description string, pub string")
    got = rows(M.upserted(old, new, ["n", "kind"], ["title", "description"], ["description"]))
    assert got == [("1", None, "T", "d", "keep", False), ("2", "B", "t", "d", "keep", False), ("3", "A", "T", "D", "P", True)]


def test_duplicates_and_versions(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, pos int, v string")
    assert rows(M.last_of_each(df, ["k"], F.col("pos"))) == [("a", 3, "z", 1), ("b", 2, "y", 2)]
    assert rows(M.first_of_each(df, ["k"], F.col("pos"))) == [("a", 1, "x"), ("b", 2, "y")]
    good, bad = M.split_valid(df, {"big": F.col("pos") > 2})
    assert (good.count(), rows(bad)) == (2, [("a", 3, "z", "big")])
    path = M.write_version(df, str(tmp_path))
    assert M.read_version(spark, path).count() == 3


def test_whitelists(spark):
    df = spark.createDataFrame([(1, ["H01M 10/05", "x"], ["ACME Ltd"]), (2, ["B60K1/02"], None), (3, None, ["Other"]), (4, ["H01M1/00"], ["the acme"])], "i int, codes array<string>, names array<string>")
    code, name = WL.code_matches(F.col("codes"), ["H01M10", "B60K1/02"]), WL.name_matches(F.col("names"), ["acme"])
    assert rows(df.select("i", code, name)) == [(1, True, True), (2, True, False), (3, False, False), (4, False, True)]
    assert rows(WL.counted(df, code, name)) == [(1, 1, 1, 1)]
    assert WL.listed(" a, ,B", lower=True) == ["a", "b"]
    forms = spark.createDataFrame([(1, ["H04L0065101600"]), (2, ["h04l 65/1016 (2022.01)"]), (3, ["H04L65/1017"]), (4, ["H04L 65"]), (5, ["/x"])], "i int, codes array<string>")
    passing = lambda *allowed: [r.i for r in forms.where(WL.code_matches(F.col("codes"), list(allowed))).orderBy("i").collect()]
    assert passing("H04L65/1016") == passing("H04L 65/1016") == passing("H04L0065101600") == [1, 2]
    assert passing("h04l 65") == [1, 2, 3, 4] and passing("H04L6") == [] and passing("") == []
    assert df.where(WL.code_matches(F.col("codes"), [])).count() == 0


def test_speeds(spark):
    s = [("b", 0, 1, 0), ("b", 10_000, 2, 1000), ("b", 10_100, 3, 1500), ("b", 50_000, 4, 9000), ("c", 5, 5, 5)]
    got = {r.id: r.speed for r in S.speeds(spark.createDataFrame(s, "k string, ms long, id int, bytes long"), "k", "ms", "bytes", "id").collect()}
    assert got == {1: 0.0, 2: 100.0, 3: 1500 / 10.1, 4: 0.0, 5: 0.0}


def test_nested_lists_and_pages(spark):
    p = spark.createDataFrame([(i,) for i in range(30)], "k int")
    c = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, None)], "k int, v string")
    got = {r.k: r.vs for r in L.with_nested(p, "k", L.nested(c, "k", ["v"], "vs")).collect()}
    assert (got[1], got[2], got[3]) == (["a", "b"], [], [])
    assert [r.k for r in L.page(p, [F.desc("k")], 2, 10).collect()] == list(range(19, 9, -1))
    assert L.page(p, [F.col("k")], 0, 1000).count() == 30 and L.total_pages(21, 10) == 3
    i = spark.createDataFrame([(1, 7, "i"), (2, None, "j")], "k int, asset_id int, name string")
    a = spark.createDataFrame([(7, "asset")], "id int, name string")
    assert rows(L.with_assets(i, a, ["name"])) == [(1, 7, "asset"), (2, None, "j")]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [float("nan"), 1.0])], "vec_id int, v array<double>")
    assert [r.vec_id for r in V.nearest(df.where(V.valid(F.col("v"), 2)), "v", [1.0, 0.1], 5).collect()] == [1, 3]


def test_dates_of_the_dashboard(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, d),) for d in (1, 3, 9)], "t timestamp_ntz")
    assert df.where(S.since(F.col("t"), "2024-01-09", 7)).count() == 2


def test_semantic_search(spark):
    e = spark.createDataFrame([("ipc", "A01", "1", [1.0, 0.0]), ("ipc", "B01", "1", [0.9, 0.1]), ("ipc", "C01", "1", [1.0]), ("cpc", "A02", "1", [1.0, 0.0]), ("ipc", "A03", "0", [1.0, 0.0])], "type string, code_norm string, version string, embedding array<double>")
    d = spark.createDataFrame([("A01", "1", "A", "one"), ("B01", "1", "B", "two"), ("A02", "1", "A", "x"), ("A03", "1", "A", "y")], "code_norm string, version string, section string, title_en string")
    found = V.semantic_search(e, d, [1.0, 0.0], type="ipc").collect()
    assert [(r.code_norm, r.title_en, r.percent) for r in found] == [("A01", "one", "100.0%"), ("B01", "two", "99.4%")]
    assert [r.code_norm for r in V.semantic_search(e, d, [1.0, 0.0], section="B", type="ipc").collect()] == ["B01"]
    assert [r.code_norm for r in V.search_by_text(e, d, " two ", lambda texts: [[0.0, len(texts[0])]], type="ipc").collect()] == ["B01", "A01"]
    got = V.embedded(d, "title_en", lambda texts: [[len(t), 1] for t in texts], 2)
    assert sorted(r.embedding for r in got.collect()) == [[1.0, 1.0], [1.0, 1.0], [3.0, 1.0], [3.0, 1.0]]


def test_hashes_and_likeness_of_pictures(spark):
    rng = __import__("random").Random(2)
    pixels = [rng.randrange(256) for _ in range(16 * 16)]
    light = [200 if i % 16 > 7 else 30 for i in range(256)]
    df = spark.createDataFrame([(1, pixels, light), (2, pixels[::-1], light), (3, None, None)], "i int, p array<int>, q array<int>")
    got = {r.i: r for r in df.select("i", IF.phash("p").alias("bits"), IF.black_and_white("q").alias("bw")).collect()}
    assert len(got[1].bits) == 63 and sum(got[1].bits) == 31 and got[3].bits is None and got[3].bw is None
    assert got[1].bw == [255 if v == 200 else 0 for v in light]
    import math

    low = [sum(pixels[16 * y + x] * math.cos((2 * x + 1) * u * math.pi / 32) * math.cos((2 * y + 1) * v * math.pi / 32) for y in range(16) for x in range(16)) for v in range(8) for u in range(8)][1:]
    assert got[1].bits == [int(c > sorted(low)[31]) for c in low]
    same = df.where("i < 3").select(IF.hash_score(F.col("p"), F.col("p"), F.col("q"), F.col("q")), IF.structure("q", "q"), IF.agreement("q", "q")).first()
    assert tuple(round(x, 9) for x in same) == (1.0, 1.0, 1.0)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x01\x02\x03\x04\x01\x01\x11\x00\xff\xd9"
    sizes = spark.createDataFrame([(1, bytearray(jpeg)), (2, bytearray(b"\x89PNG")), (3, None)], "i int, c binary").select("i", IF.jpeg_size("c").alias("s")).select("i", "s.*")
    assert rows(sizes) == [(1, 772, 258), (2, None, None), (3, None, None)]


def test_images_and_their_assets(spark):
    images = spark.createDataFrame([("p", "k1", True, "", None), ("p", "k1", True, "", None), ("p", "none", False, "inline", 90)], "patent_id string, oss_key string, is_abstract boolean, image_role string, display_rotation int")
    assets = spark.createDataFrame([("k1", "a1")], "oss_key string, id string")
    assert [(r.asset_id, r.image_role, r.display_rotation) for r in W.image_rows(images, assets).collect()] == [("a1", "abstract", 0)]
    found = IM.candidates(spark.createDataFrame([("p", "a", True), ("p", "d1", False), ("p", "d2", False), ("q", "x", True)], "k string, file_name string, f boolean"), "k", F.col("f"))
    assert found.count() == 8
    same = spark.createDataFrame([("p", "b", "h"), ("p", "a", "h"), ("p", "c", "g")], "k string, file_name string, h string")
    assert rows(IM.same_content(same, "k", "h").select("file_name", "matched_file_name")) == [("a", "a"), ("b", "a"), ("c", "c")]


def test_upserts_by_their_keys(spark):
    asset = "oss_key string, content_hash string, perceptual_hash string, content_type string, size int, width int, height int"
    old = spark.createDataFrame([("k", "old", "p", "t", 1, 1, 1)], asset)
    new = spark.createDataFrame([("k", "h1", None, "u", 2, 0, 3, 1), ("k", "h2", "q", "v", 9, 9, 9, 2), ("n", None, None, "w", 5, 5, 0, 3)], asset + ", at int")
    got = rows(W.upserted_assets(old, new, F.col("at")).select("oss_key", "content_hash", "perceptual_hash", "content_type", "size", "width", "height", "is_new"))
    assert got == [("k", "h1", "p", "u", 2, None, 3, False), ("n", "legacy:n", None, "w", 5, 5, None, True)]
    entry = spark.createDataFrame([("A01", "1", "one"), ("B01", "1", "two")], "code_norm string, version string, title_en string")
    more = spark.createDataFrame([("A01", "2", None)], "code_norm string, version string, title_en string")
    assert rows(W.upserted_entries(entry, more)) == [("A01", "2", None, False), ("B01", "1", "two", False)]
    key = [("ipc", "A01", "1", "zh", "m", "x")]
    vectors = spark.createDataFrame(key, "type string, code_norm string, version string, locale string, embedding_model string, content string")
    again = spark.createDataFrame([(*key[0][:5], "y"), (*key[0][:4], "m2", "z")], vectors.schema)
    assert [r[-2:] for r in rows(W.upserted_embeddings(vectors, again))] == [("y", False), ("z", True)]


def test_log_is_appended_in_todays_wording(spark, tmp_path):
    for message in ("Start processing step", "other"):
        W.append_log(spark.createDataFrame([("b", message)], "batch_code string, message string"), str(tmp_path / "log"))
    assert rows(spark.read.parquet(str(tmp_path / "log")).select("message")) == [("other",), ("开始处理步骤",)]


def test_titles_are_folded_in_order(spark):
    df = spark.createDataFrame([("a", 1, "X; Y", "f1"), ("a", 2, "Y", "f2"), ("a", 3, "Z", "f3"), ("b", 4, "T", "f4")], "k string, at int, t string, file string")
    assert rows(CL.merged_titles(df, "k", "t", "at")) == [("a", "X; Y; Z", "f1"), ("b", "T", "f4")]


def test_folders(spark):
    from vellum.sources import listing

    df = spark.createDataFrame([("/g/2023", "2023", "directory"), ("/g/2023/202301", "202301", "directory"), ("/g/2024", "2024", "directory"), ("/g/2024/202401", "202401", "directory"), ("/g/2024/x.txt", "x.txt", "file"), ("/h/1", "1", "directory")], "path string, name string, type string")
    assert [r.name for r in listing.data_folders(df, "/g/").collect()] == ["202401", "202301"]
    assert [r.name for r in listing.browse_order(df).collect()] == ["1", "2023", "202301", "2024", "202401", "x.txt"]
    assert [r.name for r in listing.folders_like(df, "^2024$").collect()] == ["2024"]
    assert [r.n for r in L.by_name(spark.createDataFrame([("b",), ("A",), ("é",), ("f",), ("a",)], "n string"), "n").collect()] == ["a", "A", "b", "é", "f"]
