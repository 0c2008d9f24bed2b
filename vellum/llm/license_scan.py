"""License scans by conditional compression.

Candidate blocks are found by cue words: the line of a cue, up to ``AROUND`` characters to either side,
the ``FOLLOWING`` lines behind it, over which a notice may be wrapped, and as many characters as before if a
license's whole text begins with it. Blocks less than ``GAP`` characters apart are one, and what is longer than
``BLOCK`` is cut into windows that overlap by more than any template is long, so no block's size is without a
bound and no notice is cut. Each block is compressed alone and with each template as a raw zstandard
dictionary. What the dictionary saves, as a share of the template's own compressed size, ranks the templates:
it does not depend on what else is in the block. Templates of ``LONG_WORDS`` words or more that save less than
``LEAST`` of themselves are given up; all others are confirmed by the exact differences in wording: the
alignment of template words at each place of the block where the template may begin, the words that are
missing, and the words that stand between. The best with no more than ``MISSING`` of its words missing and
``ADDED`` of as many added wins. Words that carry a version or a variant (a number that is no list's, or a word
such as NC, lesser, affero, only) must neither be missing nor added, and in templates of under ``LONG_WORDS``
words no short word or number may be missing. A block may hold several notices: the words of a winner are
taken out and the rest is looked at again.

Licenses whose wording is long (Apache, GPL, MPL, EPL and their relatives) are known by the title that their
texts begin with, by the notice that they ask for, and by their names and SPDX identifiers; other Creative
Commons licenses than BY, BY-SA, BY-NC 4.0 and CC0 are not known.

Each task scans its own texts; nothing is shuffled. Equal blocks are compressed once. Null and empty texts hold
no license, repeated rows are scanned each, of wordings that fit equally well the longest wins, very long texts
are scanned whole, an empty table gives no rows, columns beside id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from vellum.llm.license_texts import TEMPLATES

#: Characters on either side of a cue that belong to its block at most; and between blocks that are joined.
AROUND, GAP = 2000, 200
#: Lines behind a cue's line that belong to its block.
FOLLOWING = 2
#: Characters of a block at most, and by how many its windows overlap: more than a template with added words has.
BLOCK, OVERLAP = 8000, 3000
#: Words of a long template; share of its own compressed size that one must save; share of words that may be missing, and that may be added.
LONG_WORDS, LEAST, MISSING, ADDED = 30, 0.2, 0.08, 0.15
LEVEL = 9
#: Words that tell licenses of nearly one wording apart, alone or as a part of a word with hyphens.
VARIANTS = frozenset("lesser affero only later nc sa nd noncommercial sharealike noderivatives noderivs".split())
#: Blocks whose result a worker remembers.
REMEMBERED = 20_000

#: Cues of whole texts of licenses: their blocks go on over the lines behind them.
LONG = r"permission (?:is|to)|redistribution and use|free software|free and unencumbered|\(the \"license\"\)|subject to the terms"
CUES = r"licen[cs]e|all rights reserved|public domain|creative commons|\bcc0\b|\bcc[ -]by\b|\b[al]?gpl|\bmpl\b|express or implied warranty|" + LONG
_CUES, _LONG = re.compile(CUES, re.IGNORECASE), re.compile(LONG, re.IGNORECASE)
_WORD = re.compile(r"\w+(?:[-.']\w+)*", re.UNICODE)


def words_of(text: str) -> list[tuple[str, int, int]]:
    """Words in lower case, with their places."""
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def blocks_of(text: str) -> list[tuple[int, int]]:
    """Places of the candidate blocks of a text."""
    out: list[list[int]] = []
    for m in _CUES.finditer(text):
        start = max(text.rfind("\n", 0, m.start()) + 1, m.start() - AROUND)
        end = len(text) if _LONG.fullmatch(m[0]) else text.find("\n", m.end())
        for _ in range(FOLLOWING):
            end = text.find("\n", end + 1) if 0 <= end < m.end() + AROUND else end
        end = min(len(text) if end < 0 else end, m.end() + AROUND)
        if out and start <= out[-1][1] + GAP:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(at, min(at + BLOCK, b)) for a, b in out for at in range(a, max(a + 1, b - OVERLAP), BLOCK - OVERLAP)]


@lru_cache(maxsize=1)
def _compressors() -> tuple[zstandard.ZstdCompressor, list[zstandard.ZstdCompressor], list[int]]:
    options = {"format": zstandard.FORMAT_ZSTD1_MAGICLESS, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    plain = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(LEVEL, **options))
    by_template = []
    for _, text in TEMPLATES:
        raw = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        by_template.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=zstandard.ZstdCompressionParameters.from_level(LEVEL, **options)))
    return plain, by_template, [len(plain.compress(text.lower().encode())) for _, text in TEMPLATES]


def reductions(block: str) -> list[tuple[float, int]]:
    """(what a template saves of a block's compressed size, as a share of its own, template), best first; of equals the longer template."""
    plain, by_template, own = _compressors()
    raw = block.lower().encode()
    alone = len(plain.compress(raw))
    found = [((alone - len(c.compress(raw))) / own[i], i) for i, c in enumerate(by_template)]
    return sorted(found, key=lambda f: (-f[0], -len(TEMPLATES[f[1]][1]), f[1]))


@lru_cache(maxsize=len(TEMPLATES))
def _template_words(i: int) -> tuple[str, ...]:
    return tuple(w for w, _, _ in words_of(TEMPLATES[i][1]))


def decides(words: Sequence[str], k: int, versions: bool = False) -> bool:
    """Whether word ``k`` is one of a version or a variant; with ``versions`` any number is one, else only one behind "version"."""
    word = words[k]
    if not VARIANTS.isdisjoint(re.split("[-.']", word)) or word == "library" and words[k + 1 : k + 2] == ["general"]:
        return True
    return any(c.isdigit() for c in word) and (versions or (k > 0 and words[k - 1] in ("version", "v")))


@lru_cache(maxsize=len(TEMPLATES))
def _deciding(i: int) -> frozenset[int]:
    """Words of a template that must be there: numbers of lists are none of them."""
    words, text = _template_words(i), TEMPLATES[i][1]
    lists = {k for k, (_, a, _) in enumerate(words_of(text)) if re.match(r"[0-9]+\.\s", text[a:]) and (a == 0 or text[a - 1] == "\n")}
    return frozenset(k for k in range(len(words)) if k not in lists and decides(words, k, versions=True))


@lru_cache(maxsize=len(TEMPLATES))
def _needed(i: int) -> tuple[frozenset[str], int, int]:
    """Different words of a template, how many may be missing, and how many added."""
    n = len(_template_words(i))
    return frozenset(_template_words(i)), int(MISSING * n), int(ADDED * n) + (n >= LONG_WORDS)


def aligned(template: Sequence[str], words: list[str], may_miss: int, may_add: int) -> tuple[list[int], list[int]]:
    """Places of the template's words that are missing, and of the others between, in the best run of ``words`` from the first on.

    A run within both bounds goes first, then the one with the least differences, then the shortest.
    """
    n = len(template)
    table = [[0] * (len(words) + 1)]  # longest common subsequences
    for word in template:
        last, row = table[-1], [0]
        for j, other in enumerate(words):
            row.append(last[j] + 1 if word == other else max(last[j + 1], row[j]))
        table.append(row)
    end = min(range(1, len(words) + 1), key=lambda j: (n - table[n][j] > may_miss or j - table[n][j] > may_add, n + j - 2 * table[n][j], j))
    missing, added, k, j = [], [], n, end
    while k or j:
        if k and j and template[k - 1] == words[j - 1]:
            k, j = k - 1, j - 1
        elif k and (not j or table[k - 1][j] >= table[k][j - 1]):
            k -= 1
            missing.append(k)
        else:
            j -= 1
            added.append(j)
    return missing[::-1], added[::-1]


def wording(words: list[str], i: int) -> tuple[int, int, list[int], list[int]] | None:
    """First and last word of the block that are aligned to template ``i``, places of its words that are missing and of those added between.

    None if the block has nowhere enough of its words. A short template may begin wherever one of its first words stands,
    a long one near three of its first words in a row; the place with the least differences is taken, the first of equals.
    """
    template, (different, may_miss, may_add) = _template_words(i), _needed(i)
    if len(different.difference(words)) > may_miss:
        return None
    n, best = len(template), None
    if n < LONG_WORDS:
        heads = set(template[: may_miss + 1])
        for start, word in enumerate(words):
            if word in heads:
                segment = words[start : start + n + may_add]
                missing, added = aligned(template, segment, may_miss, may_add)
                fits = len(missing) <= may_miss and len(added) <= may_add
                if best is None or (not fits, len(missing) + len(added)) < best[0]:
                    best = (not fits, len(missing) + len(added)), start, start + n - len(missing) + len(added), missing, [start + k for k in added]
        return best and best[1:]
    heads = {template[k : k + 3]: k for k in reversed(range(min(n, may_miss + 6) - 2))}
    for start in dict.fromkeys(max(0, p - k) for p in range(len(words) - 2) if (k := heads.get(tuple(words[p : p + 3]))) is not None):
        segment = words[start : start + n + may_add + may_miss]
        found = [b for b in SequenceMatcher(None, template, segment, autojunk=False).get_matching_blocks() if b.size]
        if not found:
            continue
        first, last = found[0].b, found[-1].b + found[-1].size
        matched = {k for b in found for k in range(b.b, b.b + b.size)}
        there = {k for b in found for k in range(b.a, b.a + b.size)}
        missing, added = [k for k in range(n) if k not in there], [start + k for k in range(first, last) if k not in matched]
        if best is None or len(missing) + len(added) < len(best[2]) + len(best[3]):
            best = start + first, start + last, missing, added
    return best


def confirmed(words: list[str], i: int) -> tuple[int, int, int, int] | None:
    """First and last word of template ``i`` in a block, and numbers of words missing and added; None if the wording differs too much."""
    if (found := wording(words, i)) is None:
        return None
    first, last, missing, added = found
    template, (_, may_miss, may_add) = _template_words(i), _needed(i)
    if len(missing) > may_miss or len(added) > may_add or not _deciding(i).isdisjoint(missing) or any(decides(words, k) for k in added):
        return None
    if len(template) < LONG_WORDS and any(len(template[k]) < 3 or any(c.isdigit() for c in template[k]) for k in missing):
        return None
    return first, last, len(missing), len(added)


@lru_cache(maxsize=REMEMBERED)
def scanned(block: str) -> tuple[tuple[str, int, int, float, int, int], ...]:
    """(license, start, end, reduction, words missing, words added) of the notices in a block."""
    words, out = words_of(block), []
    while words:
        text = block[words[0][1] : words[-1][2]] if not out else " ".join(block[a:b] for _, a, b in words)
        plain, best = [w for w, _, _ in words], None
        for share, i in reductions(text):
            n = len(_template_words(i))
            if n >= LONG_WORDS and share < LEAST or (found := confirmed(plain, i)) is None:
                continue
            rank = (found[2] + found[3]) / n, -n
            if best is None or rank < best[0]:
                best = rank, i, share, found
        if best is None:
            break
        _, i, share, (first, last, missing, added) = best
        out.append((TEMPLATES[i][0], words[first][1], words[last - 1][2], share, missing, added))
        words = words[:first] + words[last:]
    return tuple(sorted(out, key=lambda x: x[1:3]))


def notices(text: str) -> list[tuple[str, int, int, float, int, int]]:
    """The notices of a text: those of its blocks, once where windows overlap; of two that overlap the longer stays."""
    found = [(name, start + a, start + b, *rest) for start, end in blocks_of(text) for name, a, b, *rest in scanned(text[start:end])]
    out: list[tuple] = []
    for x in sorted(set(found), key=lambda x: (x[1], -x[2], x[0])):
        if out and x[1] < out[-1][2]:
            out[-1] = max(out[-1], x, key=lambda y: y[2] - y[1])
        else:
            out.append(x)
    return out


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc id, ``license``, ``start``, ``end``, ``reduction``, ``n_missing``, ``n_added``): the notices in each text."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows, out = [], []
            for row in range(batch.num_rows):
                for notice in notices(batch.column(1)[row].as_py()):
                    rows.append(row)
                    out.append(notice)
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["id", "license", "start", "end", "reduction", "n_missing", "n_added"])

    columns = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    columns = columns.where(columns.text.rlike(f"(?i){CUES}"))
    kind = columns.schema["id"].dataType.simpleString()
    return columns.mapInArrow(batches, f"id {kind}, license string, start long, end long, reduction double, n_missing long, n_added long").withColumnRenamed("id", id_column)
