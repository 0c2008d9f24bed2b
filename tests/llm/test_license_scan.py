import random

from vellum.llm import license_scan as L
from vellum.llm.license_texts import TEMPLATES


def names(text):
    return [x[0] for x in L.notices(text)]


def test_every_template_is_found_in_prose():
    rng = random.Random(0)
    prose = lambda: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(80))
    for name, text in TEMPLATES:
        assert names(f"{prose()}\n{text}\n{prose()}") == [name], text[:60]
        assert names(f"{prose()}. {text} {prose()}") == [name], text[:60]


def test_wording_decides_between_neighbours():
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert names("Licensed under CC BY-SA 4.0.\nAll rights reserved.") == ["CC-BY-SA-4.0", "all-rights-reserved"]
    assert names("A license to kill. The driver's license was free software to them.") == []
    text = TEMPLATES[0][1].replace("free of charge", "without charge").replace("merge, ", "")
    assert [(x[0], x[4] > 0) for x in L.scanned(text)] == [("MIT", True)]


def test_reduction_ranks_the_own_template_first():
    for i, (_, text) in enumerate(TEMPLATES):
        assert L.reductions(text)[0][1] == i or len(text) < 200


def test_a_short_notice_beside_long_texts_that_fail():
    edited = [" ".join(w for i, w in enumerate(text.split()) if i % 5) for _, text in TEMPLATES if len(text) > 600]
    for notice, name in (("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("All rights reserved.", "all-rights-reserved")):
        for text in edited:
            assert name in names(f"{text}\n{notice}\n")
        assert name in names(" ".join(edited)[:1500] + "\n" + notice)


def test_notices_over_lines():
    assert names("Licensed under CC\nBY 4.0.\nmore") == ["CC-BY-4.0"]
    assert names("Licensed under\nCC BY\n4.0.") == ["CC-BY-4.0"]
    assert names("x\n\nThis work is licensed under the GNU General\nPublic License,\nversion 2.\n") == ["GPL-2.0"]


def test_versions_and_variants_of_long_notices():
    gpl = {version: next(text for name, text in TEMPLATES if name == f"GPL-{version}.0-or-later") for version in (2, 3)}
    for version, text in gpl.items():
        assert names(text) == names(text.replace("hope that it", "hope it")) == [f"GPL-{version}.0-or-later"]
        for kind, name in (("Lesser", "LGPL"), ("Affero", "AGPL"), ("Library", None)):
            assert names(text.replace("GNU General", f"GNU {kind} General")) == ([f"{name}-3.0-or-later"] if version == 3 and name else [])
        for other in ("1", "2.1"):
            assert names(text.replace(f"version {version}", f"version {other}")) == []
        assert names(text.replace(", or (at your option) any later version", " only")) == []
    bsd = next(text for name, text in TEMPLATES if name == "BSD-2-Clause")
    assert names(bsd.replace("1. ", "* ").replace("2. ", "* ")) == ["BSD-2-Clause"]
    assert names("This work is licensed under the GNU Lesser General Public License, version 2.") == []
    assert names("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.") == []


def test_rows(spark):
    texts = ["x " * 50000 + "\nReleased under the MIT License.", None, "", "none", "é Licensed under CC BY 4.0. é"]
    docs = spark.createDataFrame([*enumerate(texts), (4, texts[4])], "doc_id long, text string")
    rows = L.scan(docs).collect()
    assert sorted((r.doc_id, r.license, texts[r.doc_id][r.start : r.end]) for r in rows) == [(0, "MIT", "Released under the MIT License")] + [(4, "CC-BY-4.0", "Licensed under CC BY 4.0")] * 2
    assert L.scan(docs.where("false")).count() == 0


def test_lines_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id for r in L.scan(docs).collect()}
    lines = docs.where("text rlike '(Released under the MIT|Licensed under the Apache|licensed under the GNU General|Licensed under CC BY-NC|All rights reserved)'")
    assert {r.doc_id for r in lines.collect()} <= found


def test_many_cues_around_a_notice():
    item = "item %d of the license copy of the software and permission notice shall be included"
    both = "Released under the MIT License. Licensed under CC BY 4.0."
    for n in (1, 20, 60, 900):
        lines = [item % k for k in range(n)]
        assert names("\n".join([*lines, both])) == ["MIT", "CC-BY-4.0"]
        assert names(" ".join([*lines[: n // 2], both, *lines[n // 2 :]])) == ["MIT", "CC-BY-4.0"]
    assert max(b - a for a, b in L.blocks_of("\n".join(item % k for k in range(2000)))) <= L.BLOCK


def test_a_license_twice_in_a_block():
    for name, text in TEMPLATES:
        assert names(f"{text}\n\n{text}") == [name] * 2, text[:60]


def test_names_titles_and_identifiers():
    assert names("SPDX-License-Identifier: MIT") == ["MIT"]
    assert names("// SPDX-License-Identifier: GPL-2.0-or-later\nint x;") == ["GPL-2.0-or-later"]
    assert names("The code is under AGPL v3 and the docs under the MIT license.") == ["AGPL-3.0", "MIT"]
    assert names("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n") == ["Apache-2.0"]
    assert names("GNU LESSER GENERAL PUBLIC LICENSE\n  Version 2.1, February 1999") == ["LGPL-2.1"]
    assert names("SPDX-License-Identifier: Other-1.0") == []


def test_alignment_as_by_brute_force():
    """A template is confirmed exactly where some run of the block's words is within its bounds."""
    rng = random.Random(5)
    for _ in range(300):
        i = rng.choice([k for k in range(len(TEMPLATES)) if len(L._template_words(k)) < 30])
        template, (_, may_miss, may_add) = L._template_words(i), L._needed(i)
        own = list(template)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(own) + 1)
            own[at : at + rng.randrange(2)] = rng.choice([[], ["word"]])
        words = [rng.choice(["the", "word", *template]) for _ in range(rng.randrange(6))] + own + [rng.choice(["the", *template]) for _ in range(6)]
        least = None
        for a in range(len(words)):
            for b in range(a + 1, min(len(words), a + len(template) + may_add) + 1):
                same = common(template, words[a:b])
                miss, add = len(template) - same, b - a - same
                if miss <= may_miss and add <= may_add:
                    least = min(least or (99,), (miss + add,))
        found = L.wording(words, i)
        fits = found is not None and len(found[2]) <= may_miss and len(found[3]) <= may_add
        assert fits == (least is not None), (template, words)


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]
