import random
import re

import numpy as np
from pyspark.sql import functions as F

from vellum.functions import conditions as C
from vellum.operators import text_index as X


def test_same_rows_as_a_scan(spark, tmp_path, monkeypatch):
    for name, value in {"BLOCK_ROWS": 60, "PART_ROWS": 250, "SCANNED": 0.5}.items():
        monkeypatch.setattr(X, name, value)
    rng = random.Random(6)
    words = ["Battery", "batter", "cell", "CELLS", "Ünïcode", "电池组", "\U0001f600x\U0001f600", "50%", "a_b", "back\\slash", "İstanbul", "ΑΣ", "x", ""]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(6))), rng.choice([None, "note " + rng.choice(words)])) for i in range(600)]
    rows += [(None, "without a key", None), (7, "twice", "b"), (7, "twice", "b"), (8, "needle in a hay" * 300, None)]
    table = spark.createDataFrame(rows, "k int, title string, note string").repartition(4)
    index = X.build(table, str(tmp_path / "i"), ["title", "note"], "k")
    assert index.rows == len(rows)

    def same(condition, needs):
        got, want = (sorted(map(tuple, df.collect()), key=str) for df in (X.find(index, condition, needs), table.where(condition)))
        assert got == want
        return len(want)

    hits = 0
    for value in ("BATTERY", "tte*cel", "电池组", "池组", "\U0001f600x\U0001f600", "50% ", "a_b", "k\\sl", "istanbul", "ασ", "zzz", "needle"):
        hits += same(C.contains(F.col("title"), value), [[("title", C.like_pattern(value))]]) > 0
    assert hits >= 8
    assert same(C.contains(F.col("title"), "needle") | C.contains(F.col("note"), "nïcode"), [[("title", "%needle%")], [("note", "%nïcode%")]]) > 1
    assert same(C.contains(F.col("title"), "battery") & C.contains(F.col("note"), "50%"), [[("title", "%battery%"), ("note", r"%50\%%")]]) > 0
    assert same(C.contains_raw(F.col("title"), "b%tter_ c"), [[("title", "%b%tter_ c%")]]) > 0


def test_rare_values_read_few_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_ROWS", 50)
    monkeypatch.setattr(X, "PART_ROWS", 300)
    table = spark.range(3000).selectExpr("id", "concat('common text ', if(id % 1000 = 7, 'Rarity', 'plain'), ' ', id) as title")
    index = X.build(table, str(tmp_path / "i"), ["title"], "id")
    read = lambda value: X.find(index, C.contains(F.col("title"), value), [[("title", C.like_pattern(value))]])
    rare = read("rarity")
    assert sorted(r.id for r in rare.collect()) == [7, 1007, 2007]
    blocks = re.search(r"PartitionFilters: \[[^]]*block#\d+ IN \(([0-9,]+)\)", rare._jdf.queryExecution().toString())
    assert len(blocks[1].split(",")) <= 3
    assert read("common").selectExpr("input_file_name() as f").distinct().count() > 40
    postings = X._of_grams(index, "postings", "title", sorted(X.trigrams("rar")), X._POSTINGS)
    assert postings.selectExpr("sum(size(places)) as n").first().n == 3
    none = X.build(table.where("false"), str(tmp_path / "none"), ["title"], "id")
    assert X.find(none, C.contains(F.col("title"), "rarity"), [[("title", "%rarity%")]]).count() == 0


def test_fragments():
    assert X.fragments(r"%a\%b%c_d\\%") == ["a%b", "c", "d\\"] and X.fragments("%%") == []
    assert len(X.trigrams("abcabc")) == 3 and X.trigrams("ab") == set()


def test_trigrams_are_made_of_bounded_slices(monkeypatch):
    rng = np.random.default_rng(2)
    texts = ["", "ab", *("".join(rng.choice(list("abcß語😀"), n)) for n in (3, 4, 5, 40, 2, 9, 300)), ""]
    want = sorted((g, i) for i, t in enumerate(texts) for g in X.trigrams(t))
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(X, "SLICE", size)
        assert sorted(zip(*(x.tolist() for x in X._grams(texts)))) == want
    assert X._grams([])[0].tolist() == X._grams(["a", "b"])[0].tolist() == []
