"""Token counts by finite-state tokenizer compilation.

Two deterministic finite transducers count the tokens of byte-level BPE without making them. The splitter
(see ``pretokens``) finds where pre-tokens begin: state maps of fixed chunks are composed by a parallel
prefix scan. The word transducer reads a pre-token's bytes; its transitions are annotated with the number of
tokens that a byte adds (it may be negative, as a longer token can replace several), so that the sum over a
path is the count. Its state is what of the past can still matter: each place behind which the bytes read so
far begin some longer token, with the token that ends at that place and the count there, relative to the
count now. That is finitely much whatever the pre-token's length, and it is compiled from the vocabulary as
far as it is needed: the last token of a prefix's encoding is its longest suffix that is a token and follows
the last token of the rest in a valid pair.

A long pre-token is cut into chunks. Each chunk has a map from entry state to exit state and tokens emitted, known at
the states that have been asked for and kept by the chunk's bytes. Maps of neighbours are composed in pairs, these in pairs again, and
so on, each from its own beginning alone, so that a scan of any number of chunks has as many steps as their number has
binary digits; a map that is asked at a new state asks its two halves. States forget soon, so that nearly all are known then.

Counts of pre-tokens are remembered by a hash; the bytes are compared before a count is used. Null texts count
as empty (0 bytes, 0 tokens); repeated rows are counted each; a very long text is a slice of its own. An empty
table gives no rows. Columns beside id and text are not read, whatever their names.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.arrowtext import span_hashes, text_slices
from vellum.llm.bpe import gathered
from vellum.llm.pretokens import pretoken_spans

#: States that a worker keeps before it compiles anew; bytes of a chunk of a pre-token, and maps of chunks that are kept.
KEPT_STATES, CHUNK, KEPT_MAPS = 200_000, 64, 50_000
#: Counts by pre-token that a worker keeps before it starts anew, and the longest of these.
KEPT_WORDS, KEPT_LENGTH = 1_000_000, 256


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary file stands for."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTransducer:
    """A finite transducer of pre-tokens' bytes that emits numbers of tokens.

    A state is a tuple of numbers of entries; an entry is (bytes that have been read behind a place, the token that ends
    there, tokens up to there less tokens up to now). State 0 is the beginning: nothing read, no token before.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.beginnings = {token[:i] for token in ranks for i in range(1, len(token))}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forgets all states but the first."""
        self.next: dict[int, int] = {}  # by 256 * state + byte: 1024 * next state + tokens emitted + 512
        self.entries: list[tuple[bytes, bytes, int]] = [(b"", b"", 0)]
        self.number_of_entry = {self.entries[0]: 0}
        self.states: list[tuple[int, ...]] = [(0,)]
        self.number_of_state = {(0,): 0}
        self.maps: dict[tuple[int, bytes], tuple[int, int]] = {}

    def valid(self, left: bytes, right: bytes) -> bool:
        """Whether the bytes of two tokens are encoded as these two."""
        key = (left, right)
        if (known := self.pairs.get(key)) is None:
            parts = [bytes([b]) for b in left + right]
            while len(parts) > 1:
                rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank == 1 << 60:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            known = parts == [t for t in (left, right) if t]
            if len(self.pairs) > KEPT_STATES:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def compiled(self, state: int, byte: int) -> int:
        """The transition of a state at a byte, made and kept; entries of a state are in order of places, so the first token that fits is the longest."""
        added, token, emitted, left = bytes([byte]), None, 0, []
        for e in self.states[state]:
            read, before, count = self.entries[e]
            read += added
            if token is None and read in self.ranks and (len(read) == 1 and not before or self.valid(before, read)):
                token, emitted = read, count + 1
            if read in self.beginnings:
                left.append((read, before, count))
        entries = [(read, before, count - emitted) for read, before, count in left] + [(b"", token, 0)]
        for entry in entries:
            if entry not in self.number_of_entry:
                self.number_of_entry[entry] = len(self.entries)
                self.entries.append(entry)
        key = tuple(self.number_of_entry[entry] for entry in entries)
        if key not in self.number_of_state:
            self.number_of_state[key] = len(self.states)
            self.states.append(key)
        step = self.next[state * 256 + byte] = self.number_of_state[key] * 1024 + emitted + 512
        return step

    def walk(self, state: int, part: bytes) -> tuple[int, int]:
        """Exit state of some bytes from an entry state, and the tokens emitted."""
        total, known = 0, self.next
        for byte in part:
            step = known.get(state * 256 + byte)
            if step is None:
                step = self.compiled(state, byte)
            state = step >> 10
            total += (step & 1023) - 512
        return state, total

    def mapped(self, state: int, chunk: bytes) -> tuple[int, int]:
        """A chunk's map at an entry state."""
        key = state, chunk
        if (found := self.maps.get(key)) is None:
            if len(self.maps) > KEPT_MAPS:
                self.maps.clear()
            found = self.maps[key] = self.walk(state, chunk)
        return found

    def count(self, word: bytes) -> int:
        """The tokens of a pre-token: the sum of what the transitions emit."""
        if len(self.states) > KEPT_STATES:
            self.reset()
        if len(word) <= CHUNK:
            return self.walk(0, word)[1]
        chunks = [word[i : i + CHUNK] for i in range(0, len(word), CHUNK)]
        levels: list[list[dict[int, tuple[int, int]]]] = [[{} for _ in chunks]]

        def at(level: int, k: int, state: int) -> tuple[int, int]:
            """Exit state and tokens of the ``k``-th map of a level at an entry state."""
            own = levels[level][k]
            if state not in own:
                if not level:
                    own[state] = self.mapped(state, chunks[k])
                else:
                    middle, first = at(level - 1, 2 * k, state)
                    end, second = at(level - 1, 2 * k + 1, middle) if 2 * k + 1 < len(levels[level - 1]) else (middle, 0)
                    own[state] = end, first + second
            return own[state]

        while True:
            for k in range(len(levels[-1])):
                at(len(levels) - 1, k, 0)
            if len(levels[-1]) == 1:
                return at(len(levels) - 1, 0, 0)[1]
            levels.append([{} for _ in range(-(-len(levels[-1]) // 2))])


class KnownCounts:
    """Counts of pre-tokens by their bytes: found by hash, and compared."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.data, self.used = np.zeros(1 << 16, np.uint8), 0
        self.starts, self.lengths, self.counts = (np.zeros(1 << 12, np.int64) for _ in range(3))

    def add(self, key: int, word: bytes, count: int) -> None:
        n = len(self.place)
        if n == len(self.starts):
            self.starts, self.lengths, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.counts))
        while self.used + len(word) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.used : self.used + len(word)] = np.frombuffer(word, np.uint8)
        self.starts[n], self.lengths[n], self.counts[n] = self.used, len(word), count
        self.used += len(word)
        self.place[key] = n

    def find(self, keys: list[int], data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The count of each span of ``data``, -1 where it is not known."""
        at = np.fromiter(map(self.place.get, keys, repeat(-1)), np.int64, len(keys))
        out = np.full(len(keys), -1, np.int64)
        hit = np.flatnonzero(at >= 0)
        hit = hit[self.lengths[at[hit]] == lengths[hit]]
        own, kept = gathered(data, starts[hit], lengths[hit]), gathered(self.data, self.starts[at[hit]], lengths[hit])
        out[hit] = self.counts[at[hit]]
        if len(wrong := np.flatnonzero(own != kept)):
            out[hit[np.searchsorted(np.cumsum(lengths[hit]), wrong, side="right")]] = -1
        return out


class TokenCounter:
    """Counts of tokens of slices of texts by a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        of = byte_of_character()
        whole = {token: id for token, id in parts["model"]["vocab"].items()}
        order: dict[bytes, int] = {bytes([b]): b - 256 for b in range(256)}
        for rank, merge in enumerate(parts["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            order.setdefault(bytes(of[c] for c in left + right), rank)
        if len(order) != len(whole):
            raise ValueError("not a byte-level vocabulary that its merges make")
        self.special = [t["content"].encode() for t in parts["added_tokens"]]
        self.words = WordTransducer(order)
        self.known = KnownCounts()

    def special_spans(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Starts and ends of the special strings within the texts, leftmost first."""
        found = []
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, side="right"))
                if at + len(token) <= offsets[text]:
                    found.append((at, at + len(token)))
                    at = raw.find(token, at + len(token))
                else:
                    at = raw.find(token, at + 1)
        out, end = [], 0
        for span in sorted(found, key=lambda s: (s[0], -s[1])):
            if span[0] >= end:
                out.append(span)
                end = span[1]
        return np.array(out, np.int64).reshape(-1, 2)

    def counted(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of tokens of each text of a slice."""
        raw = data.tobytes()
        special = self.special_spans(raw, offsets)
        starts, ends, firsts = pretoken_spans(data, offsets, special)
        if not len(starts):
            return np.zeros(len(offsets) - 1, np.int64)
        hashes = span_hashes(data, starts, ends, lower=False)
        if len(self.known.place) > KEPT_WORDS:
            self.known.clear()
        keys = hashes.tolist()
        counts = self.known.find(keys, data, starts, ends - starts)
        made: dict[bytes, int] = {}
        for i in np.flatnonzero(counts < 0).tolist():
            word = raw[starts[i] : ends[i]]
            n = made.get(word)
            if n is None:
                n = made[word] = self.words.count(word)
                if keys[i] not in self.known.place and len(word) <= KEPT_LENGTH:
                    self.known.add(keys[i], word, n)
            counts[i] = n
        for a, b in special:  # one token for all of its characters
            inside = slice(*np.searchsorted(starts, [a, b]))
            counts[inside] = 0
            counts[inside.start] = 1
        return np.diff(np.concatenate([[0], np.cumsum(counts)])[firsts])


@functools.lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    """The counter of a vocabulary file; a worker reads it once."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: its id, ``n_bytes``, ``n_tokens`` and ``over_limit``, whether it has over ``limit`` tokens.

    ``path`` is the place of the vocabulary file, the same on every machine. Special strings inside
    texts are special tokens, one token each.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in source:
            for row, end, data, offsets in text_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, end - row),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array(tokens.counted(data, offsets), pa.int64()),
                ], ["id", "n_bytes", "n_tokens"])

    columns = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    kind = columns.schema["id"].dataType.simpleString()
    counted = columns.mapInArrow(batches, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
