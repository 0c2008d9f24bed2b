import pytest
from pyspark.sql import functions as F

from vellum.functions import codes
from vellum.functions import conditions as C
from vellum.functions import text as T


def one(spark, make, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_codes(spark):
    long = one(spark, lambda c: codes.displayed(codes.normalized(c)), "H01B0001000000", "H01M0004130000", "H04L0065101600", "h01b1/023 (2026.05)", "Y02A20/108", "H01B　 1/00")
    assert long == ["H01B 1/00", "H01M 4/13", "H04L 65/1016", "H01B 1/023", "Y02A 20/108", "H01B 1/00"]
    assert one(spark, codes.normalized, "(2006.01)", " ", "A01B0000020000", "odd", "A01B01/00", "A01B9999000000", "A01B0010100000", "I01B0001000000") == [None, None, None, "ODD", "A01B01/00", "A01B9999/00", "A01B10/10", "I01B0001000000"]
    assert one(spark, codes.normalized_or_compact, "A01B 0000020000", "h01b 1/02", "(2006.01)") == ["A01B0000020000", "H01B1/02", "(2006.01)"]
    assert one(spark, codes.depth, "H01B1/X2", "H01B12345/0012345", "H01X9") == [4, 4, 0]
    assert one(spark, codes.class_code, "H", "H01", "H01X9", "H01B1/A") == [None, "H01", None, "H01"] and one(spark, codes.subgroup, "H01B1/A", "H01B1/00") == ["A", "00"]
    assert one(spark, codes.depth_label, "H", "H01", "H01B", "H01B1/00", "H01B1/02") == ["section", "class", "subclass", "main_group", "subgroup"]
    with pytest.raises(Exception, match="invalid classification code"):
        one(spark, codes.checked, "A01B0000020000")
    assert one(spark, codes.depth, "H", "H01", "H01B", "H01B1/00", "H01B1/02", "X-1") == [0, 1, 2, 3, 4, 0]
    assert one(spark, codes.parent, "H", "H01", "H01B", "H01B1/00", "H01B1/02") == [None, "H", "H01", "H01B", "H01B1/00"]
    assert one(spark, codes.ancestors, "Y02A20/108", "H") == [["Y", "Y02", "Y02A", "Y02A20/00"], []]


def test_conditions(spark):
    assert C.like_pattern("50%_a\\*?") == "%50\\%\\_a\\\\%_%"
    with pytest.raises(C.ConditionError):
        C.like_pattern(" ")
    for bad in ("2024-02-31", "x", "2024-13", "2024-1-1-1", "24", "202", "2024-", "2024-001"):
        with pytest.raises(C.ConditionError):
            C.on_date(F.lit("x"), bad)
    assert one(spark, lambda c: C.on_date(c, "2024-12"), "2024-12-31", "2025-01-01", None) == [True, False, None]
    assert one(spark, lambda c: C.on_date(c, "2024-1-5"), "2024-01-05", "2024-1-5") == [True, False]
    assert one(spark, lambda c: C.code_prefix(c, "H04L0065101600"), "H04L65/1016", "H04L65/101") == [True, False]
    assert one(spark, lambda c: C.code_prefix(c, " h01b 1/00 (2006.01)"), "H01B1/00", "H01B10/00") == [True, False]
    for bad in ("(2006.01)", "A01B0000020000"):
        with pytest.raises(C.ConditionError):
            C.code_prefix(F.lit("x"), bad)
    assert one(spark, lambda c: C.contains(c, "A%b"), "xa%by", "aXb") == [True, False]
    assert one(spark, lambda c: C.contains_raw(c, "a%b\\"), "a-b\\", "ab") == [True, False]
    assert one(spark, lambda c: C.code_prefix(c, "h01m"), "H01M4/13", "XH01M") == [True, False]
    assert one(spark, lambda c: ~C.contains(c, "q"), None, "a") == [None, True]
    assert one(spark, lambda c: C.code_contains(c, "A01B0010020000"), "A01B10/02", "A01B10/20") == [True, False]


def test_existence_never_multiplies(spark):
    parents = spark.createDataFrame([(1,), (2,)], "k int")
    children = spark.createDataFrame([(1, "a"), (1, "ab"), (2, None)], "k int, v string")
    assert sorted(map(tuple, C.has_child(parents, children, "k", C.contains(F.col("v"), "a"), "f").collect())) == [(1, True), (2, False)]


def test_texts(spark):
    assert one(spark, T.iso_date, "2023.10.03", "20231399", "2023", None) == ["2023-10-03", "2023-13-99", None, None]
    assert [str(x) for x in one(spark, T.checked_date, "2023-10-03", "2023-13-99")] == ["2023-10-03", "None"]
    assert one(spark, T.kind_label, "A", "B", None, "", "C1") == ["发明申请", "发明授权", "-", "-", "C1"]
    assert one(spark, T.image_key, "a\\B/C.JPG", "x.tif") == ["c.jpg", "x.tif"]
    assert one(spark, T.content_type, "x.TIF", "x", "y.jp2", None) == ["image/tiff", "image/jpeg", "image/jp2", "image/jpeg"]
    assert one(spark, T.independent_claim, "如权利要求 1 所述", "根据权利要求12", "一种装置") == [False, False, True]
    cited = "见CN102030405A和US1234567，申请号：201510145456.1，专利号 CN123456X, xCN999999999, CN1234567", None
    assert one(spark, T.cited_documents, *cited) == [["CN123456", "201510145456.1", "CN102030405"], []]
    assert one(spark, lambda c: T.crc_text(c.cast("binary")), "123456789", "") == ["CBF43926", "00000000"]
    assert one(spark, lambda c: T.batch_code(F.lit("invention"), c), "/a/20231003RawData/", "/a/20231003", "/a/other", "") == ["CN-PA-TXTS-10-B-20231003-Raw", "CN-PA-TXTS-10-B-20231003", "CN-PA-TXTS-10-B-other", "CN-PA-TXTS-10-B-"]
    assert one(spark, T.split_values, " a ;; b") == [["a", "b"]]
    assert one(spark, lambda c: T.size_text(c.cast("long")), "5", "1536", "1073741824") == ["5 B", "1.5 KB", "1.00 GB"]
    assert one(spark, T.log_message, "imported 5 patents", None, "A.ZIP: x") == ["imported 5 patents", None, "A.ZIP: x"]
    assert one(spark, lambda c: T.duration_text(c.cast("double")), "-1", "0.4", "59.4", "150", "4500", "3600") == [None, "< 1s", "59s", "2m 30s", "1h 15m", "1h"]
    assert one(spark, lambda c: T.transfer_text(c.cast("long"), F.lit(104857600)), "52428800", "0") == ["50.0 MB / 100.0 MB (50%)", "0 B / 100.0 MB (0%)"]
    assert one(spark, T.is_uuid, "0f8fad5b-d9cb-469f-a165-70867728950e", "0F8FAD5B-D9CB-469F-A165-70867728950E", "x", None) == [True, True, False, None]


def test_several_values_at_once_as_one_by_one(spark):
    parents = spark.createDataFrame([(1, "solar cell", None), (2, None, "x"), (3, "urgent", "cell"), (4, "none", None)], "k int, title string, abstract string")
    names = spark.createDataFrame([(2, "Cell Ltd"), (2, "cells"), (4, None), (9, "cell")], "k int, name string")
    ipc = spark.createDataFrame([(4, "H01M 10/05", "H01M10/05"), (1, "A", None)], "k int, ipc_code string, code_norm string")
    values, texts = ["cell", "h01m 10", "zz"], ["title", "abstract"]
    one = {(r.k, v) for v in values for r in C.default_field(parents, "k", texts, [names], ipc, v).collect()}
    got = [(r.k, r.asked) for r in C.default_field_each(parents, "k", texts, [names], ipc, values).collect()]
    assert sorted(got) == sorted(one) and len(one) == 4
    values = ["c_ll", "m10/", "%"]
    one = {(r.k, v) for v in values for r in C.free_search(parents, "k", texts, names, ipc, v).collect()}
    got = [(r.k, r.asked) for r in C.free_search_each(parents, "k", texts, names, ipc, values).collect()]
    assert sorted(got) == sorted(one) and len(one) == 8
