"""Splitting of texts into pre-tokens by a finite-state transducer.

The split pattern of byte-level BPE vocabularies (contractions, runs of
letters, of numbers and of other characters with one space before them, runs
of white space) is a deterministic transducer of eleven states over twelve
classes of characters. A transition says whether a pre-token begins at the
character read, or at the one before it. A stream of texts is cut into chunks
of equal length; each chunk gives a map from entry to exit state, the maps are
composed by a parallel prefix scan, and with every chunk's entry state known a
second pass over all chunks at once marks where pre-tokens begin.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

#: Characters of a chunk.
CHUNK = 256
#: Steps after which chunks whose map is already constant are followed once only.
SETTLE = 8

# Classes of characters; the letters that contractions are made of have their own.
LETTER, NUMBER, OTHER, SPACE, WHITE, QUOTE, ENDING, R, V, L, E, BREAK = range(12)
#: Characters with the property White_Space, without the space itself.
WHITE_SPACE = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# States: at a text's start; in a run; behind white space; behind a quote that may begin a contraction.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_WHITE, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, CONTRACTED = range(11)
STATES = 11
#: Marks of a transition: a pre-token begins here, or began one character before.
HERE, BEFORE = 16, 32


@functools.cache
def character_classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            table[point] = LETTER
        elif kind == "N":
            table[point] = NUMBER
    table[WHITE_SPACE] = WHITE
    table[ord(" ")] = SPACE
    table[ord("'")] = QUOTE
    table[[ord(c) for c in "stmd"]] = ENDING
    for c, kind in (("r", R), ("v", V), ("l", L), ("e", E)):
        table[ord(c)] = kind
    return table


def _from_run(state: int, kind: int) -> int:
    """Next state and marks from any state in which no contraction is open."""
    if kind == BREAK:
        return START | HERE
    attached = state == AFTER_SPACE
    white = state in (AFTER_SPACE, AFTER_WHITE)
    if kind in (SPACE, WHITE):
        return (AFTER_SPACE if kind == SPACE else AFTER_WHITE) | (0 if white else HERE)
    run = IN_NUMBERS if kind == NUMBER else IN_OTHERS if kind in (OTHER, QUOTE) else IN_LETTERS
    marks = (BEFORE if white else 0) | (0 if attached or state == run else HERE)
    if kind == QUOTE and state != IN_OTHERS and not attached:
        return QUOTED | marks
    return run | marks


def _transition(state: int, kind: int) -> int:
    if state == QUOTED:
        if kind == ENDING:
            return CONTRACTED
        if kind in (R, V, L):
            return {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[kind]
        return _from_run(IN_OTHERS, kind)
    if state in (QUOTED_R, QUOTED_V, QUOTED_L):
        if kind == (L if state == QUOTED_L else E):
            return CONTRACTED
        return _from_run(IN_LETTERS, kind) | BEFORE
    return _from_run(state, kind)


@functools.cache
def transitions() -> np.ndarray:
    """Next state and marks by 16 * state + class; class 12 ends the stream."""
    table = np.zeros(16 * 16, np.uint8)
    for state in range(STATES):
        for kind in range(12):
            table[16 * state + kind] = _transition(state, kind)
        table[16 * state + 12] = START | (BEFORE if state in (QUOTED_R, QUOTED_V, QUOTED_L) else 0)
    return table


@functools.cache
def begins_here() -> np.ndarray:
    """Whether a pre-token begins at the character read, by place in the table of transitions."""
    return (transitions() & HERE) > 0


@functools.cache
def began_before() -> np.ndarray:
    """Whether a pre-token began one character earlier, by place in the table of transitions."""
    return (transitions() & BEFORE) > 0


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte that each begins at."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[at].astype(np.int32)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    for lead, limit, top, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        which = np.flatnonzero((data[at] >= lead) & (data[at] < limit))
        if len(which):
            value = points[which] & top
            for i in range(1, more + 1):
                value = (value << 6) | (padded[at[which] + i] & 0x3F)
            points[which] = value
    return np.minimum(points, 0x10FFFF), at


def state_maps(classes: np.ndarray) -> np.ndarray:
    """Exit state of each chunk for each entry state; ``classes`` has a row for each step."""
    table = (transitions() & 15) << 4  # states times 16, so that adding a class gives the place in the table
    maps = np.tile(np.arange(STATES, dtype=np.uint8) << 4, (classes.shape[1], 1))
    settle = min(SETTLE, len(classes))
    for kinds in classes[:settle]:
        maps = table[maps + kinds[:, None]]
    settled = (maps == maps[:, :1]).all(axis=1)
    one, rest = maps[settled, 0], maps[~settled]
    left, right = classes[settle:, settled], classes[settle:, ~settled]
    for kinds in left:
        one = table[one + kinds]
    if len(rest):
        for kinds in right:
            rest = table[rest + kinds[:, None]]
    maps[settled], maps[~settled] = one[:, None], rest
    return maps >> 4


def scanned(maps: np.ndarray) -> np.ndarray:
    """Entry state of every chunk: the inclusive prefix composition of the maps, by doubling."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    return np.concatenate([[START], maps[:-1, START]]).astype(np.uint8)


def pretoken_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of the pre-tokens of a slice's texts, and the number before each text.

    ``breaks`` are starts and ends of spans that no pattern is applied to; each of their characters
    is a span of its own in the result.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    points, at = code_points(data)
    kinds = character_classes()[points]
    if breaks is not None and len(breaks):
        inside = np.zeros(n + 1, np.int8)
        np.add.at(inside, breaks[:, 0], 1)
        np.add.at(inside, breaks[:, 1], -1)
        kinds[np.cumsum(inside)[at] > 0] = BREAK
    # a break stands before each text
    texts = np.flatnonzero(offsets[:-1] < offsets[1:])
    firsts = np.searchsorted(at, offsets[texts])
    stream = np.insert(kinds, firsts, BREAK)
    is_text = np.ones(len(stream), bool)
    is_text[firsts + np.arange(len(firsts))] = False
    padded = np.full(-(-(len(stream) + 1) // CHUNK) * CHUNK, 12, np.uint8)
    padded[: len(stream)] = stream
    steps = np.ascontiguousarray(padded.reshape(-1, CHUNK).T)
    state = scanned(state_maps(steps))
    table, places = (transitions() & 15) << 4, np.empty_like(steps)
    state <<= 4
    for i, row in enumerate(steps):
        places[i] = state + row
        state = table[places[i]]
    places = np.ascontiguousarray(places.T).reshape(-1)
    begins = begins_here()[places]
    begins[:-1] |= began_before()[places[1:]]
    starts = at[begins[: len(stream)][is_text]]
    ends = np.append(starts[1:], n)
    return starts, ends, np.searchsorted(starts, offsets)
