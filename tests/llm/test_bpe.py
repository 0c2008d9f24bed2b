import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.llm import bpe as B
from vellum.llm import token_counts as C

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "hello world's don't", " " * 500, "ééé 漢字 \U0001f600‍", "a" * 5000, "x<|endoftext|>y <|endoftext|><|endoftext|>", "<|endoftext|", "\r\n\r\n\tif (x): return 'll 're", "0123456789" * 30, "'" * 700]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(RANKS), special_tokens={})


def test_perfect_hash_is_minimal_and_perfect():
    for n in (1, 2, 3, 50, 3000):
        keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
        assert sorted(B.PerfectHash(keys).slots(keys).tolist()) == list(range(len(keys)))


def test_encode_as_the_library_and_back(spark, library):
    rows = [(i, t, "x") for i, t in enumerate([*ODD, *ODD[:2], None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    for row in B.encode(docs, RANKS).collect():
        text = rows[row.doc_id][1] or ""
        assert row.ids == library.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()
    for row in B.encode_digests(docs, RANKS).collect():
        ids = library.encode_ordinary(rows[row.doc_id][1] or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((rows[row.doc_id][1] or "").encode()).hexdigest()
    assert B.encode_digests(docs.where("false"), RANKS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_texts(library, texts):
    import pyarrow as pa

    whole = tokenizers.Tokenizer.from_file(JSON) if not hasattr(test_any_texts, "t") else test_any_texts.t
    test_any_texts.t = whole
    for row, end, data, offsets in B.text_slices(pa.array(texts, pa.string())):
        ids, firsts = B.vocabulary(RANKS).encoded(data, offsets)
        counts = C.counter(JSON).counted(data, offsets)
        for i in range(end - row):
            assert ids[firsts[i] : firsts[i + 1]].tolist() == library.encode_ordinary(texts[row + i])
            assert counts[i] == len(whole.encode(texts[row + i], add_special_tokens=False).ids)


def test_counts_as_the_library(spark):
    whole = tokenizers.Tokenizer.from_file(JSON)
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    for row in C.count_tokens(docs, JSON).collect():
        text = ([*texts, None])[row.doc_id] or ""
        assert row.n_tokens == len(whole.encode(text, add_special_tokens=False).ids), text[:80]
        assert (row.n_bytes, row.over_limit) == (len(text.encode()), row.n_tokens > 512)
    assert C.count_tokens(docs.where("false"), JSON).agg(F.sum("n_tokens")).first()[0] is None


def test_states_are_finite_and_chunks_compose(library):
    words = C.WordTransducer(C.counter(JSON).words.ranks)
    rng = np.random.default_rng(0)
    for text in ("a" * 20_000, "ab" * 9_000, "=" * 7_001, "".join(rng.choice(list("etaoin"), 8_000)), "".join(rng.choice(list("0123456789"), 5_000)), "xyz" * 21 + "q"):
        word = text.encode()
        assert words.count(word) == words.walk(0, word)[1] == len(library.encode_ordinary(text))
    words.reset()
    words.count(b"a" * 100_000)
    assert len(words.states) < 1000


def test_chunks_are_mapped_a_bounded_number_of_times(library, monkeypatch):
    words = C.WordTransducer(C.counter(JSON).words.ranks)
    asked, plain = [], words.mapped
    monkeypatch.setattr(words, "mapped", lambda state, chunk: asked.append(1) or plain(state, chunk))
    rng = np.random.default_rng(1)
    for text in ("a" * 1_000_000, "ab" * 100_000, "".join(rng.choice(list("etaoinshrdlu"), 60_000))):
        asked.clear()
        assert words.count(text.encode()) == words.walk(0, text.encode())[1]
        assert len(asked) <= 3 * len(text) / C.CHUNK
    # states that remember all that was read: each chunk is asked once for each level at most
    monkeypatch.setattr(words, "mapped", lambda state, chunk: asked.append(1) or ((state * 31 + chunk[0] + 1) % 1_000_003, state % 7))
    word = bytes(rng.integers(0, 256, 64 * 1024).astype(np.uint8))
    state = total = 0
    for i in range(0, len(word), C.CHUNK):
        state, total = (state * 31 + word[i] + 1) % 1_000_003, total + state % 7
    asked.clear()
    assert words.count(word) == total and len(asked) <= 1024 * 11


def test_a_clash_of_hashes_gives_no_wrong_count():
    known = C.KnownCounts()
    data = np.frombuffer(b"wordlong", np.uint8)
    known.add(7, b"word", 3)
    spans = np.array([0, 4, 0]), np.array([4, 4, 3])
    assert known.find([7, 7, 7], data, *spans).tolist() == [3, -1, -1]
    for i in range(5000):
        known.add(1000 + i, b"w%d" % i, i)
    assert known.find([1000 + 4321], np.frombuffer(b"w4321", np.uint8), np.array([0]), np.array([5])).tolist() == [4321]
