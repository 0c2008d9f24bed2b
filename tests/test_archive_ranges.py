import gzip
import io
import random
import struct
import zipfile

import pytest

from vellum.sources import archive_ranges as A
from vellum.sources import archives


def zipped(entries, method=zipfile.ZIP_DEFLATED, before=b"", wide=False, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, content in entries:
            with z.open(zipfile.ZipInfo(name) if method == zipfile.ZIP_STORED else _info(name, method), "w", force_zip64=wide) as f:
                f.write(content)
        z.comment = comment
    return before + out.getvalue()


def _info(name, method):
    info = zipfile.ZipInfo(name)
    info.compress_type = method
    return info


class OneWay(io.RawIOBase):
    """A file that cannot go back, so that sizes follow the entries."""

    def __init__(self):
        self.out = io.BytesIO()

    def writable(self):
        return True

    def write(self, data):
        return self.out.write(data)


def split(data, sizes):
    """An archive as a split one: a mark before it, entries told by part and place in it."""
    whole = bytearray(b"PK\7\10" + data)
    end = whole.rfind(b"PK\5\6")
    count, length, at = struct.unpack_from("<H2L", whole, end + 10)
    edges = [0]
    for size in sizes:
        edges.append(edges[-1] + size)
    assert edges[-1] < end
    where = lambda x: max(k for k, e in enumerate(edges) if e <= x)
    place = at + 4
    for _ in range(count):
        n, e, c = struct.unpack_from("<3H", whole, place + 28)
        offset = struct.unpack_from("<L", whole, place + 42)[0] + 4
        struct.pack_into("<H", whole, place + 34, where(offset))
        struct.pack_into("<L", whole, place + 42, offset - edges[where(offset)])
        place += 46 + n + e + c
    struct.pack_into("<2H", whole, end + 4, len(sizes), where(at + 4))
    struct.pack_into("<L", whole, end + 16, at + 4 - edges[where(at + 4)])
    return [bytes(whole[a:b]) for a, b in zip(edges, [*edges[1:], len(whole)])]


def put(folder, name, parts):
    for k, part in enumerate(parts[:-1]):
        (folder / f"{name}.z{k + 1:02d}").write_bytes(part)
    (folder / f"{name}.zip").write_bytes(parts[-1])


def found(rows):
    got = rows.collect()
    return sorted((r.zip_name, r.entry_name, bytes(r.content)) for r in got if r.error is None), sorted((r.zip_name, str(r.entry_name), r.error) for r in got if r.error is not None)


def some_entries(n, seed=1):
    rng = random.Random(seed)
    return [(f"d/{i}.xml" if i % 3 else f"{i}.jpg", rng.randbytes(rng.randrange(3000))) for i in range(n)]


@pytest.mark.parametrize("form", ["plain", "stored", "wide", "moved", "commented", "split", "cut", "streamed"])
def test_all_forms_give_the_same_entries(spark, tmp_path, form, monkeypatch):
    monkeypatch.setattr(A, "PIECE", 100)
    monkeypatch.setattr(A, "CHUNK", 10_000)
    entries = some_entries(60)
    data = zipped(entries, zipfile.ZIP_STORED if form == "stored" else zipfile.ZIP_DEFLATED, b"#!/bin/sh\n" if form == "moved" else b"", form == "wide", b"PK\5\6 in a comment" if form == "commented" else b"")
    if form == "split":
        put(tmp_path, "a", split(data, [20_000, 7, 0, 19_999, 20_001]))
    elif form == "cut":  # parted without a word of it in the archive
        put(tmp_path, "a", [data[:5000], data[5000:5001], data[5001:]])
    elif form == "streamed":
        out = OneWay()
        with zipfile.ZipFile(io.BufferedWriter(out), "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in entries:
                z.writestr(name, content)
        (tmp_path / "a.zip.gz").write_bytes(gzip.compress(out.out.getvalue()))
    else:
        put(tmp_path, "a", [data])
    got, errors = found(archives.entries(spark, str(tmp_path)))
    assert errors == [] and got == sorted(("a.zip", n, c) for n, c in entries if n.endswith(".xml"))


def test_chunks_are_spread_and_inner_archives_stay_packed(tmp_path, monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 10_000)
    inner = zipped(some_entries(90))
    (tmp_path / "outer.zip").write_bytes(zipped([("in.ZIP", inner), ("x.xml", b"<x/>")], zipfile.ZIP_STORED))
    rows = list(A.chunks([str(tmp_path / "outer.zip")], (".xml",)))
    assert len(rows) > 6 and {r[0] for r in rows} == {"in.ZIP", "outer.zip"}
    assert sum(len(r[3]) for r in rows) == 61 and not any(m.name == "in.ZIP" for r in rows for m in r[3])


def test_archives_in_archives_in_any_packing(spark, tmp_path):
    deep = zipped([("1.xml", b"<a/>")])
    middle = zipped([("deep.zip", deep), ("2.xml", b"<b/>"), ("no.txt", b"")])
    for k, method in enumerate((zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)):
        (tmp_path / f"outer{k}.zip").write_bytes(zipped([(f"m{k}.zip", middle), ("g.xml.gz", gzip.compress(b"<g>") + gzip.compress(b"</g>"))], method))
    (tmp_path / "m2.zip.gz").write_bytes(gzip.compress(middle))
    got, errors = found(archives.entries(spark, str(tmp_path)))
    want = [("deep.zip", "1.xml", b"<a/>")] * 3 + [(f"m{k}.zip", "2.xml", b"<b/>") for k in range(3)] + [("g.xml.gz", "g.xml", b"<g></g>")] * 2
    assert errors == [] and got == sorted(want)
    assert found(archives.whole_entries(spark, str(tmp_path))) == (got, errors)


def test_damage_is_told_where_it_is(spark, tmp_path):
    entries = [(f"{i}.xml", bytes([65 + i]) * 50) for i in range(6)]
    data = bytearray(zipped(entries, zipfile.ZIP_STORED))
    data[data.find(b"C" * 50) + 3] ^= 1
    (tmp_path / "one.zip").write_bytes(data)
    parts = split(zipped(some_entries(30)), [9000, 9000])
    put(tmp_path, "lost", [parts[0], parts[2]])
    put(tmp_path, "short", [parts[0], parts[1][:-100], parts[2]])
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    (tmp_path / "empty.zip").write_bytes(b"")
    (tmp_path / "cut.zip.gz").write_bytes(gzip.compress(zipped(entries))[:-30])
    (tmp_path / "none.zip").write_bytes(zipped([]))
    with zipfile.ZipFile(tmp_path / "other.zip", "w") as z:
        z.writestr("b.xml", b"<b/>", zipfile.ZIP_BZIP2)
        z.writestr("\u00e9.xml", b"<c/>")
    (tmp_path / "latin.zip").write_bytes(zipped([("e.xml", b"<d/>")]).replace(b"e.xml", b"\xe9.xml"))
    got, errors = found(archives.entries(spark, str(tmp_path)))
    assert {(a, b) for a, b, _ in errors} >= {("one.zip", "2.xml"), ("lost.zip", "None"), ("bad.zip", "None"), ("empty.zip", "None"), ("other.zip", "b.xml")}
    assert any(a == "lost.zip" and "2 of 3 parts" in c for a, _, c in errors)
    assert {a for a, _, _ in errors} == {"one.zip", "lost.zip", "short.zip", "bad.zip", "empty.zip", "other.zip", "cut.zip.gz"}
    assert [r[1] for r in got if r[0] == "one.zip"] == ["0.xml", "1.xml", "3.xml", "4.xml", "5.xml"]
    assert ("other.zip", "\u00e9.xml", b"<c/>") in got and ("latin.zip", "\u00e9.xml", b"<d/>") in got


def test_chunks_are_unpacked_one_at_a_time():
    import pyarrow as pa

    from vellum.sources import archive_ranges as A

    class Batch:
        """Cannot be made objects of whole."""

        rows = pa.RecordBatch.from_pylist([{"zip_name": x, "error": "no"} for x in "ab"])
        num_rows = 2

        def slice(self, at, n):
            assert n == 1
            return self.rows.slice(at, n)

    assert list(A._read([Batch()], (".xml",))) == [("a", None, None, "no"), ("b", None, None, "no")]
