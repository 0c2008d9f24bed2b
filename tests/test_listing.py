import os

import pytest

from vellum.sources import listing


def test_walk_gives_files_and_directories(spark, tmp_path):
    for year, week in (("2023", "w2"), ("2023", "w1"), ("2024", "W9"), ("notes", "deep/er")):
        (tmp_path / year / week).mkdir(parents=True)
    (tmp_path / "2023" / "w1" / "A b%20.ZIP").write_bytes(b"12345")
    (tmp_path / "2023" / "empty.zip").write_bytes(b"")
    (tmp_path / "top.xml").write_bytes(b"<a/>")
    found = listing.walk(spark, str(tmp_path))
    want = set()
    for top, folders, names in os.walk(tmp_path):
        want |= {(f"{top}/{x}", x, "directory", 0) for x in folders} | {(f"{top}/{x}", x, "file", os.path.getsize(f"{top}/{x}")) for x in names}
    rows = found.collect()
    assert {(r.path, r.name, r.type, r["size"]) for r in rows} == want and len(rows) == len(want)
    assert all(abs(r.modified.timestamp() - os.path.getmtime(r.path)) < 1 for r in rows)
    # what is made of listings takes it as it is
    assert [r.name for r in listing.data_folders(found, str(tmp_path)).collect()] == ["W9", "w2", "w1", "deep"]
    assert {r.name for r in listing.folders_like(found, "^w").collect()} == {"w1", "w2"}
    order = [r.name for r in listing.browse_order(listing.walk(spark, str(tmp_path), levels=1)).collect()]
    assert order == ["2023", "2024", "notes", "top.xml"]
    plan = listing.download_plan(found.where("type = 'file'"), found.where("name = 'top.xml'"))
    assert {(r.name, r.state) for r in plan.collect()} == {("A b%20.ZIP", "pending"), ("empty.zip", "pending"), ("top.xml", "skipped")}


def test_walk_of_many_directories_is_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "LISTED", 10)
    for i in range(120):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "x").write_bytes(b"1")
    found = listing.walk(spark, "file://" + str(tmp_path))
    assert found.count() == 240
    files = found.where("type = 'file'")
    assert files.selectExpr("input_file_name() as f").distinct().count() >= 8
    (tmp_path / "none").mkdir()
    assert listing.walk(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        listing.walk(spark, str(tmp_path / "not there"))
