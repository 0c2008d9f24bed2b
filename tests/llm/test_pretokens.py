import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import pretokens as P
from vellum.llm.arrowtext import text_slices

PATTERN = regex.compile(public_tokenizers.PATTERN)


def split(texts):
    out = []
    for row, end, data, offsets in text_slices(pa.array(texts, pa.string())):
        starts, ends, firsts = P.pretoken_spans(data, offsets)
        raw = data.tobytes()
        for i in range(end - row):
            out.append([raw[a:b].decode() for a, b in zip(starts[firsts[i] : firsts[i + 1]], ends[firsts[i] : firsts[i + 1]])])
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="'stredlvma A1?! \n\t é中² \U0001f600", max_size=30), max_size=6), st.sampled_from([4, 16, 256]))
def test_spans_are_the_matches_of_the_pattern(texts, chunk):
    P.CHUNK = chunk
    try:
        assert split(texts) == [PATTERN.findall(t) for t in texts]
    finally:
        P.CHUNK = 256


def test_long_runs_cross_chunks():
    for text in (" " * 1000 + "a", "?" * 900 + "'s", "\n" * 700, "a" * 3000 + "'re'll", "'" * 513):
        assert split([text, "", text]) == [PATTERN.findall(text), [], PATTERN.findall(text)]


def test_scan_composes_maps_in_order():
    maps = np.random.default_rng(0).integers(0, P.STATES, (37, P.STATES)).astype(np.uint8)
    state, expected = P.START, []
    for m in maps:
        expected.append(state)
        state = m[state]
    assert P.scanned(maps).tolist() == expected
