"""Byte-level BPE encoding and decoding by a two-tier lookup.

Texts are cut into pre-tokens. Tier one: a minimal perfect hash over the
vocabulary gives the only slot that a pre-token can have; if the slot holds
the same bytes, its rank is the whole encoding. Tier two: what misses is
encoded by merges, lowest rank first, kept in a heap over a linked list of
bytes. Each task works on its own slices of text; nothing is shuffled.

Null texts are encoded like empty ones (no ids), repeated rows independently,
a text longer than a slice as a slice of its own. The input's other columns do
not matter: only ``id_column`` and ``text_column`` are read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.llm.arrowtext import mixed, span_hashes, task_memory, text_slices
from vellum.llm.pretokens import pretoken_spans

#: Encodings of missed pre-tokens that a task remembers before it starts anew.
REMEMBERED = 200_000
#: Keys of a bucket of the perfect hash, on average.
BUCKET = 4


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PerfectHash:
    """A minimal perfect hash of 64-bit hashes by displacement: ``n`` keys, ``n`` slots."""

    def __init__(self, hashes: np.ndarray):
        self.n = n = len(hashes)
        self.buckets = max(1, n // BUCKET)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        firsts = np.concatenate([[0], np.cumsum(sizes)])
        self.displacement = np.zeros(self.buckets, np.int64)
        self.key_of_slot = np.full(n, -1, np.int64)
        for b in np.argsort(-sizes, kind="stable"):
            keys = order[firsts[b] : firsts[b + 1]]
            if len(keys) < 2:
                break
            trials = 64
            for first in range(1, 1 << 40, trials):
                d = np.arange(first, first + trials, dtype=np.uint64)[:, None]
                slots = self._slot(hashes[keys][None, :], d)
                free = (self.key_of_slot[slots] < 0).all(axis=1)
                row = np.sort(slots, axis=1)
                free &= (row[:, 1:] != row[:, :-1]).all(axis=1)
                if free.any():
                    i = int(np.argmax(free))
                    self.displacement[b] = first + i
                    self.key_of_slot[slots[i]] = keys
                    break
        # a bucket with one key names its slot outright
        alone = np.flatnonzero(sizes == 1)
        slots = np.flatnonzero(self.key_of_slot < 0)
        self.displacement[alone] = -1 - slots
        self.key_of_slot[slots] = order[firsts[alone]]

    def _slot(self, hashes: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (mixed(hashes ^ (d * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(self.n)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; one that is no key gets some slot."""
        d = self.displacement[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(d < 0, -1 - d, self._slot(hashes, d.astype(np.uint64)))


def _joined(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the tokens back to back, and their offsets."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), offsets


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The elements of all spans, back to back."""
    firsts = np.cumsum(lengths) - lengths
    return data[np.repeat(starts - firsts, lengths) + np.arange(int(lengths.sum()))]


class ByteBpe:
    """A vocabulary of ranks, ready to encode slices of texts and to decode ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        tokens = sorted(ranks, key=ranks.__getitem__)
        self.data, self.offsets = _joined(tokens)
        self.lengths = np.diff(self.offsets)
        hashes = span_hashes(self.data, self.offsets[:-1], self.offsets[1:], lower=False)
        self.hash = PerfectHash(hashes)
        self.ids = np.array([ranks[t] for t in tokens], np.uint32)
        self.row_of_id = np.full(int(self.ids.max(initial=0)) + 1, -1, np.int64)
        self.row_of_id[self.ids] = np.arange(len(tokens))
        self.key_hashes = hashes
        self.missed: dict[bytes, bytes] = {}

    def merged(self, word: bytes) -> list[int]:
        """Ids of a pre-token that is no entry: a heap of merges over linked bytes."""
        ranks, n = self.ranks, len(word)
        before, after, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
        heap = [(ranks[pair], i, i + 2) for i in range(n - 1) if (pair := word[i : i + 2]) in ranks]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop or not alive[j]:
                continue  # one of the two has been merged since
            end[i], after[i], alive[j] = stop, after[j], False
            if after[i] < n:
                before[after[i]] = i
                k = after[i]
                if (rank := ranks.get(word[i : end[k]])) is not None:
                    heapq.heappush(heap, (rank, i, end[k]))
            if (h := before[i]) >= 0 and (rank := ranks.get(word[h:stop])) is not None:
                heapq.heappush(heap, (rank, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = after[i]
        return out

    def encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice's texts back to back, and where each text's begin."""
        starts, ends, firsts = pretoken_spans(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), firsts
        hashes = span_hashes(data, starts, ends, lower=False)
        rows = self.hash.key_of_slot[self.hash.slots(hashes)]
        lengths = ends - starts
        hit = (self.key_hashes[rows] == hashes) & (self.lengths[rows] == lengths)
        # equal hashes are not enough: the bytes are compared
        own = gathered(data, starts[hit], lengths[hit])
        entry = gathered(self.data, self.offsets[:-1][rows[hit]], lengths[hit])
        if len(wrong := np.flatnonzero(own != entry)):
            which = np.searchsorted(np.cumsum(lengths[hit]), wrong, side="right")
            hit[np.flatnonzero(hit)[which]] = False
        misses = np.flatnonzero(~hit)
        counts = np.ones(len(starts), np.int64)
        raw, pieces = data.tobytes(), []
        if len(self.missed) > REMEMBERED:
            self.missed.clear()
        for a, b in zip(starts[misses].tolist(), ends[misses].tolist()):
            word = raw[a:b]
            ids = self.missed.get(word)
            if ids is None:
                ids = np.array(self.merged(word), np.uint32).tobytes()
                if len(word) <= 64:
                    self.missed[word] = ids
            pieces.append(ids)
        counts[misses] = [len(p) >> 2 for p in pieces]
        places = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        out[places[hit]] = self.ids[rows[hit]]
        if pieces:
            own = counts[misses]
            out[np.repeat(places[misses] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))] = np.frombuffer(b"".join(pieces), np.uint32)
        return out, np.append(places, len(out))[firsts]

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids' tokens back to back, and the offset of each token's, and of the end."""
        rows = self.row_of_id[ids]
        if (rows < 0).any():
            raise ValueError("an id is not in the vocabulary")
        lengths = self.lengths[rows]
        return gathered(self.data, self.offsets[rows], lengths), np.concatenate([[0], np.cumsum(lengths)])


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBpe:
    """The vocabulary of a rank file; a worker reads it once."""
    return ByteBpe(read_ranks(path))


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: its id, ``ids`` (array<int>) of its text and ``decoded``, the bytes that the ids stand for.

    ``path`` is the place of the rank file, the same on every machine.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        with task_memory(bpe.missed):
            for batch in source:
                for row, end, data, offsets in text_slices(batch.column(1)):
                    ids, firsts = bpe.encoded(data, offsets)
                    back, places = bpe.decoded(ids)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(row, end - row),
                        pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(ids.view(np.int32))),
                        pa.Array.from_buffers(pa.binary(), end - row, [None, pa.py_buffer(places[firsts].astype(np.int32)), pa.py_buffer(back)]),
                    ], ["id", "ids", "decoded"])

    columns = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    kind = columns.schema["id"].dataType.simpleString()
    return columns.mapInArrow(batches, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_column)


def encode_digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: its id, ``n_tokens``, ``ids_sha256`` (of the ids as little-endian 32-bit integers) and ``decoded_sha256``.

    The digests are taken beside the ids, so that no ids leave the task.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        with task_memory(bpe.missed):
            for batch in source:
                for row, end, data, offsets in text_slices(batch.column(1)):
                    ids, firsts = bpe.encoded(data, offsets)
                    back, places = bpe.decoded(ids)
                    raw, plain, bounds = ids.astype("<u4").data.cast("B") if len(ids) else b"", memoryview(back), places[firsts]
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(row, end - row),
                        pa.array(np.diff(firsts), pa.int64()),
                        pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(firsts[:-1], firsts[1:])]),
                        pa.array([hashlib.sha256(plain[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])]),
                    ], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    columns = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    kind = columns.schema["id"].dataType.simpleString()
    return columns.mapInArrow(batches, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_column)
