import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import arrowtext as A


def brute(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab A\n\té ", max_size=40)), max_size=12))
def test_shingles_match_sets_of_word_tuples(texts):
    sets = [brute(t or "") for t in texts]
    for limit in (1, 30, 1 << 20):
        A.SLICE_BYTES = limit
        found = list(A.distinct_shingles(pa.array(texts, pa.string())))
        assert [len(f) for f in found] == [len(s) for s in sets]
        for f, s in zip(found, sets):
            for g, t in zip(found, sets):
                assert len(np.intersect1d(f, g)) == len(s & t)
    A.SLICE_BYTES = 1 << 21


def test_sliced_and_large_arrays():
    whole = pa.array(["x y", None, "", "a b c d e f"], pa.large_string())
    assert [len(f) for f in A.distinct_shingles(whole[1:])] == [0, 0, 2]
    assert [len(f) for f in A.distinct_shingles(whole[:1])] == [1]
