"""ZIP and gzip archives read by ranges, whatever their size: one archive is the work of many tasks.

1. Split archives are put together by name; a task reads the end of an archive and its central directory (Zip64 too), in
   pieces, and gives the wanted entries in chunks of neighbours of about ``CHUNK`` bytes. An inner archive that is stored as it is
   is a range of the outer one, and its directory is read in the same way.
2. Chunks are dealt to tasks. A task opens the parts, reads the ranges of its entries and hands them on one by one; a checksum
   that does not fit is an error of its entry. No value holds an archive, and no task unpacks entries that are not wanted.

An inner archive that is compressed, or a gzip file, can only be read from its start: it is a chunk of its own and walked through as a
stream, entry by entry. Names are UTF-8 where an entry says so and Latin-1 otherwise. What cannot be read gives a row with ``error``:
an archive without a directory or with parts missing, an entry that is damaged, encrypted or packed in another way than by deflate.
"""

from __future__ import annotations

import struct
import zipfile
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources.listing import archive_groups, walk
from vellum.sources.stores import store_of

#: Bytes of packed entries of a chunk, and entries of it, at most; bytes that are read at once; tasks of a read at most.
CHUNK, CHUNK_ENTRIES, PIECE, TASKS = 64 << 20, 4096, 1 << 20, 1 << 16
#: Bytes of entries that are handed on together.
HANDED = 16 << 20

SCHEMA = "zip_name string, entry_name string, content binary, error string"
_CHUNKS = "zip_name string, parts array<string>, at long, members array<struct<name:string,at:long,packed:long,size:long,method:int,crc:long,flags:int>>, error string"
#: What reading a damaged archive raises.
DAMAGED = (zipfile.BadZipFile, NotImplementedError, zlib.error, OSError, EOFError, struct.error)
#: Signatures of a ZIP file's records, ways of packing, and bits of an entry's flags.
LOCAL, CENTRAL, END, END64, LOCATOR64, DESCRIPTOR = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\7\10"
STORED, DEFLATED, WHOLE_FILE = 0, 8, -1
ENCRYPTED, SIZES_FOLLOW, UTF8 = 1, 8, 0x800


class Member(NamedTuple):
    """An entry: where its header is in the parts, and what the directory says of it."""

    name: str
    at: int
    packed: int
    size: int
    method: int
    crc: int
    flags: int


class Parts:
    """The files of an archive in a row, read by ranges."""

    def __init__(self, paths: list[str]):
        self.paths, self.files, self.starts = paths, [], [0]
        for path in paths:
            store, inner = store_of(path)
            self.files.append(store.open_input_file(inner))
            self.starts.append(self.starts[-1] + self.files[-1].size())

    def read(self, at: int, n: int) -> bytes:
        """``n`` bytes; raises ``EOFError`` where the parts end before."""
        out = []
        while n > 0:
            k = bisect_right(self.starts, at) - 1
            if k >= len(self.files) or not (piece := self.files[k].read_at(min(n, self.starts[k + 1] - at), at - self.starts[k])):
                raise EOFError("the archive ends early")
            out.append(piece)
            at, n = at + len(piece), n - len(piece)
        return b"".join(out)

    @classmethod
    def held(cls, path: str, content: pa.Buffer) -> Parts:
        """An archive of one file that is in memory."""
        parts = cls([])
        parts.paths, parts.files, parts.starts = [path], [pa.BufferReader(content)], [0, content.size]
        return parts

    def pieces(self, at: int, n: int) -> Iterator[bytes]:
        while n > 0:
            yield (piece := self.read(at, min(n, PIECE)))
            at, n = at + len(piece), n - len(piece)

    def close(self) -> None:
        for file in self.files:
            file.close()


def _wide(extra: bytes, fields: list[int], sentinels: list[int]) -> list[int]:
    """Fields of which those that are at their sentinel are taken from the Zip64 extra field, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            own = at + 4
            for i, (value, sentinel) in enumerate(zip(fields, sentinels)):
                if value == sentinel:
                    form = "<Q" if sentinel == 0xFFFFFFFF else "<L"
                    fields[i] = struct.unpack_from(form, extra, own)[0]
                    own += struct.calcsize(form)
        at += 4 + n
    return fields


def directory(parts: Parts, base: int = 0, size: int | None = None) -> Iterator[Member]:
    """The entries that the central directory of an archive names; ``base`` and ``size`` are its range within the parts."""
    size = parts.starts[-1] - base if size is None else size
    tail_at = base + max(0, size - 0x10000 - 22 - 20)
    tail = parts.read(tail_at, base + size - tail_at)
    end = tail.rfind(END, 0, len(tail) - 18)
    if end < 0:
        raise zipfile.BadZipFile("no end of a central directory")
    disk, first_disk, _, count, length, at, _ = struct.unpack_from("<4H2LH", tail, end + 4)
    behind = tail_at + end
    if tail[max(0, end - 20) : end][:4] == LOCATOR64:
        own_disk, own_at, _ = struct.unpack_from("<LQL", tail, end - 16)
        near = tail_at + end - 76
        starts = parts.starts if own_disk else [base]
        behind = near if near >= base and parts.read(near, 4) == END64 else starts[own_disk] + own_at
        record = parts.read(behind, 56)
        if record[:4] != END64:
            raise zipfile.BadZipFile("no Zip64 end of a central directory")
        disk, first_disk, _, count, length, at = struct.unpack_from("<2L4Q", record, 16)
    if disk:
        if disk + 1 != len(parts.paths):
            raise zipfile.BadZipFile(f"{len(parts.paths)} of {disk + 1} parts")
        starts = parts.starts[:-1]
    else:  # what may stand before the archive moves all of it
        starts = [behind - length - at]
    yield from _central(parts, starts, starts[first_disk] + at, length, count)


def _central(parts: Parts, starts: list[int], at: int, left: int, count: int) -> Iterator[Member]:
    buffer, place, pieces = b"", 0, parts.pieces(at, left)

    def need(n: int) -> None:
        nonlocal buffer, place
        while len(buffer) - place < n:
            more = next(pieces, b"")
            if not more:
                raise zipfile.BadZipFile("the central directory ends early")
            buffer, place = buffer[place:] + more, 0

    for _ in range(count):
        need(46)
        sign, _, _, flags, method, _, _, crc, packed, size, n, e, c, disk, _, _, offset = struct.unpack_from("<4s6H3L5HLL", buffer, place)
        if sign != CENTRAL:
            raise zipfile.BadZipFile("the central directory is damaged")
        need(46 + n + e + c)
        name, extra = buffer[place + 46 : place + 46 + n], buffer[place + 46 + n : place + 46 + n + e]
        place += 46 + n + e + c
        size, packed, offset, disk = _wide(extra, [size, packed, offset, disk], [0xFFFFFFFF] * 3 + [0xFFFF])
        if disk >= len(starts):
            raise zipfile.BadZipFile("an entry is in a part that is not there")
        yield Member(_name(name, flags), starts[disk] + offset, packed, size, method, crc, flags)


def _name(raw: bytes, flags: int) -> str:
    return raw.decode("utf-8", "replace") if flags & UTF8 else raw.decode("latin-1")


def is_archive(name: str) -> bool:
    return name.lower().endswith((".zip", ".gz"))


def _data_at(parts: Parts, member: Member) -> int:
    head = parts.read(member.at, 30)
    if head[:4] != LOCAL:
        raise zipfile.BadZipFile("no header where the directory has one")
    return member.at + 30 + sum(struct.unpack_from("<2H", head, 26))


def chunks(paths: list[str], suffixes: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of ``_CHUNKS`` of an archive in parts; the last part names it."""
    try:
        parts = Parts(paths)
    except DAMAGED as e:
        yield paths[-1].rpartition("/")[2], paths, 0, [], str(e)
        return
    yield from chunks_of(parts, suffixes)
    parts.close()


def chunks_of(parts: Parts, suffixes: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of ``_CHUNKS`` of open parts."""
    paths, name = parts.paths, parts.paths[-1].rpartition("/")[2]
    if name.lower().endswith(".gz"):
        size = parts.starts[-1]
        yield name, paths, 0, [Member(name, 0, size, size, WHOLE_FILE, 0, 0)], None
    else:
        yield from _chunks(parts, name, 0, None, suffixes)


def _chunks(parts: Parts, name: str, base: int, size: int | None, suffixes: tuple[str, ...]) -> Iterator[tuple]:
    held: list[Member] = []
    try:
        for member in directory(parts, base, size):
            if is_archive(member.name):
                if member.method == STORED and member.name.lower().endswith(".zip") and not member.flags & ENCRYPTED:
                    yield from _chunks(parts, member.name.rpartition("/")[2], _data_at(parts, member), member.packed, suffixes)
                else:
                    yield name, parts.paths, member.at, [member], None
            elif member.name.lower().endswith(suffixes) and not member.name.endswith("/"):
                held.append(member)
                if len(held) >= CHUNK_ENTRIES or sum(m.packed for m in held[-1:]) >= CHUNK or held[-1].at - held[0].at >= CHUNK:
                    yield name, parts.paths, held[0].at, held, None
                    held = []
    except DAMAGED as e:
        yield name, parts.paths, base, [], str(e)
    if held:
        yield name, parts.paths, held[0].at, held, None


def unpacked(parts: Parts, member: Member) -> Iterator[bytes]:
    """The content of an entry in pieces; raises one of ``DAMAGED`` if it is not what the directory says."""
    if member.method == WHOLE_FILE:
        yield from parts.pieces(0, member.packed)
        return
    if member.flags & ENCRYPTED:
        raise NotImplementedError("the entry is encrypted")
    if member.method not in (STORED, DEFLATED):
        raise NotImplementedError(f"packed by method {member.method}")
    inflate = zlib.decompressobj(-15) if member.method == DEFLATED else None
    crc = size = 0
    for piece in parts.pieces(_data_at(parts, member), member.packed):
        piece = piece if inflate is None else inflate.decompress(piece)
        crc, size = zlib.crc32(piece, crc), size + len(piece)
        yield piece
    if crc != member.crc or size != member.size:
        raise zipfile.BadZipFile("the checksum is another")


class _Forward:
    """Bytes of a stream of pieces, forwards only."""

    def __init__(self, pieces: Iterator[bytes]):
        self.source, self.buffer = pieces, b""

    def peek(self, n: int) -> bytes:
        while len(self.buffer) < n and (more := next(self.source, None)) is not None:
            self.buffer += more
        return self.buffer[:n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        if len(out) < n:
            raise EOFError("the archive ends early")
        self.buffer = self.buffer[n:]
        return out

    def some(self) -> bytes:
        out, self.buffer = self.buffer or next(self.source, b""), b""
        return out


def walked(name: str, pieces: Iterator[bytes], suffixes: tuple[str, ...]) -> Iterator[tuple]:
    """(zip_name, entry_name, content, error) of an archive that is read as a stream, and of those in it."""
    inner = name.rpartition("/")[2]
    if not inner.lower().endswith(".gz"):
        yield from _walked_zip(inner, _Forward(pieces), suffixes)
        return
    entry = inner[:-3]
    if is_archive(entry) or entry.lower().endswith(suffixes):
        yield from _entry(inner, entry, _gunzipped(_Forward(pieces)), suffixes)


def _entry(name: str, entry: str, pieces: Iterator[bytes], suffixes: tuple[str, ...]) -> Iterator[tuple]:
    try:
        if is_archive(entry):
            yield from walked(entry, pieces, suffixes)
            for _ in pieces:  # to the end, where checksums are compared
                pass
        else:
            yield name, entry, b"".join(pieces), None
    except DAMAGED as e:
        yield name, entry, None, str(e)


def _gunzipped(source: _Forward) -> Iterator[bytes]:
    while source.peek(1):
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            if not (piece := source.some()):
                raise EOFError("the file ends early")
            yield inflate.decompress(piece)
        source.buffer = inflate.unused_data.lstrip(b"\0") + source.buffer


def _walked_zip(name: str, source: _Forward, suffixes: tuple[str, ...]) -> Iterator[tuple]:
    entry = None
    try:
        if source.peek(4) not in (LOCAL, END):
            raise zipfile.BadZipFile("no archive")
        while source.peek(4) == LOCAL:
            source.take(4)
            _, flags, method, _, _, crc, packed, size, n, e = struct.unpack("<5H3L2H", source.take(26))
            entry, extra = _name(source.take(n), flags), source.take(e)
            size, packed = _wide(extra, [size, packed], [0xFFFFFFFF] * 2)
            if flags & ENCRYPTED:
                raise NotImplementedError("the entry is encrypted")
            if method not in (STORED, DEFLATED) or (method == STORED and flags & SIZES_FOLLOW):
                raise NotImplementedError(f"packed by method {method}, without a size before it" if method == STORED else f"packed by method {method}")
            seen = [0]
            content = _inflated(source, seen) if method == DEFLATED else _taken(source, packed, seen)
            body = None
            if is_archive(entry):
                yield from _entry(name, entry, content, suffixes)
            elif entry.lower().endswith(suffixes) and not entry.endswith("/"):
                body = b"".join(content)
            for _ in content:  # what an inner archive has behind its entries
                pass
            if flags & SIZES_FOLLOW:
                if source.peek(4) == DESCRIPTOR:
                    source.take(4)
                crc = struct.unpack("<L", source.take(4))[0]
                source.take(8 if source.peek(12)[8:] in (LOCAL, CENTRAL) else 16)
            if crc != seen[0]:
                raise zipfile.BadZipFile("the checksum is another")
            if body is not None:
                yield name, entry, body, None
            entry = None
    except DAMAGED as e:
        yield name, entry, None, str(e)


def _inflated(source: _Forward, crc: list[int]) -> Iterator[bytes]:
    inflate = zlib.decompressobj(-15)
    while not inflate.eof:
        if not (piece := source.some()):
            raise EOFError("the archive ends early")
        out = inflate.decompress(piece)
        crc[0] = zlib.crc32(out, crc[0])
        if inflate.eof:
            source.buffer = inflate.unused_data
        yield out


def _taken(source: _Forward, n: int, crc: list[int]) -> Iterator[bytes]:
    while n > 0:
        out = source.take(min(n, PIECE))
        crc[0], n = zlib.crc32(out, crc[0]), n - len(out)
        yield out


def read_members(name: str, parts: Parts, members: list[Member], suffixes: tuple[str, ...]) -> Iterator[tuple]:
    """(zip_name, entry_name, content, error) of the entries of a chunk."""
    for member in members:
        if member.method == WHOLE_FILE:
            yield from walked(member.name, unpacked(parts, member), suffixes)
        else:
            yield from _entry(name, member.name, unpacked(parts, member), suffixes)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["zip_name", "entry_name", "content", "error"])


def handed_on(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``HANDED`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2] or b"") + 100
        if size > HANDED:
            yield batch_of(held)
            held, size = [], 0
    if held:
        yield batch_of(held)


def index(archives: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """Chunks of the wanted entries of archives, each a list of ``parts`` in order, the main file last."""

    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("name", pa.string()), ("at", pa.int64()), ("packed", pa.int64()), ("size", pa.int64()), ("method", pa.int32()), ("crc", pa.int64()), ("flags", pa.int32())]))
        for batch in source:
            for paths in batch.column(0).to_pylist():
                for name, parts, at, members, error in chunks(paths, suffixes):
                    columns = [pa.array([name]), pa.array([parts], pa.list_(pa.string())), pa.array([at]), pa.array([[m._asdict() for m in members]], kind), pa.array([error], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["zip_name", "parts", "at", "members", "error"])

    return archives.select("parts").mapInArrow(rows, _CHUNKS)


def entries(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".xml",)) -> DataFrame:
    """(zip_name, entry_name, content, error): a row for each wanted entry of the archives in a folder, split ones too, and of archives in these, under their own name."""
    found = walk(spark, folder).where("type = 'file'")
    tasks = found.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // CHUNK + 1
    archives = archive_groups(found.select(F.col("path").alias("name")))
    # directories are read by as many tasks as there are chunks at most, then chunks are dealt out
    n = max(spark.sparkContext.defaultParallelism, min(TASKS, tasks))
    dealt = index(archives.select("parts").repartition(n, "parts"), suffixes).repartition(n, "zip_name", "at")

    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from handed_on(_read(source, suffixes))

    return dealt.mapInArrow(rows, SCHEMA)


def _read(source: Iterator[pa.RecordBatch], suffixes: tuple[str, ...]) -> Iterator[tuple]:
    for batch in source:
        for at in range(batch.num_rows):
            (row,) = batch.slice(at, 1).to_pylist()  # of one chunk at a time
            if row["error"] is not None:
                yield row["zip_name"], None, None, row["error"]
                continue
            parts = Parts(row["parts"])
            yield from read_members(row["zip_name"], parts, [Member(**m) for m in row["members"]], suffixes)
            parts.close()
