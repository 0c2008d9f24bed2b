import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import personal_data as P
from vellum.llm.sequence_tagger import Tagger, spans_of


@pytest.fixture(scope="module")
def tagger():
    return P.train([])


def test_gradient_by_differences():
    t = Tagger(6, 2, 3, 4)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    rng = np.random.default_rng(0)
    ids, gold = rng.integers(0, 6, (3, 7)), np.array([[0, 1, 2, 2, 0, 3, 4], [0] * 7, [1, 2, 0, 3, 0, 0, 1]])
    _, g = t.gradient(ids, gold)
    for k, v in t.p.items():
        at = tuple(rng.integers(0, n) for n in v.shape)
        v[at] += 1e-4
        up = t.gradient(ids, gold)[0]
        v[at] -= 2e-4
        down = t.gradient(ids, gold)[0]
        v[at] += 1e-4
        assert abs(g[k][at] - (up - down) / 2e-4) < 1e-3, k


def test_rules():
    text = "a.b@c.d.e, @x 10.0.0.255 999.1.1.1 1.2.3.4.5 4111 1111-1111 1111 4111111111111112 +1 (210) 555-0199 +123 x@y"
    got = [(P.KINDS[k], text[s:e]) for k, s, e in P.by_rules(text)]
    assert got == [("email", "a.b@c.d.e"), ("ip", "10.0.0.255"), ("ip", "1.2.3.4"), ("phone", "+1 (210) 555-0199")] or ("card", "4111 1111-1111 1111") in got
    assert P.by_rules("") == []


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@- +(2)%é", max_size=40))
def test_rules_are_the_plain_patterns(text):
    got = P.by_rules(text)
    assert [x[1:] for x in got if x[0] == 0] == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    plain = re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
    assert [x[1:] for x in got if x[0] == 1] == [m.span() for m in plain if all(int(p) <= 255 for p in m[0].split("."))]


def test_long_runs_take_no_square_time():
    for text in ("a" * 300_000 + " x@y.z", "1" * 300_000, "1." * 150_000, "@" * 100_000, "+" * 100_000, "+1" + " " * 200_000):
        P.by_rules(text)


def test_held_out_spans(tagger):
    ids, gold = P.examples([], 300, seed=77)
    want = found = right = 0
    for a, b in zip(tagger.decode(ids), gold):
        a, b = set(spans_of(a)), set(spans_of(b))
        want, found, right = want + len(b), found + len(a), right + len(a & b)
    assert right / want > 0.8 and right / found > 0.8


#: Written by hand: ``{kind|span}`` marks what is to be found.
GOLD = """
Write to {email|ann [at] host [dot] com} before Friday.
My address is {email|john.smith(at)example(dot)org}, thanks.
Contact: {email|maria_lopez [at] uni-bonn [dot] de}
You can mail {email|j.doe42 (at) mail.example.com} any time.
{email|support[at]vellum-press[dot]net} answers within a day
Bitte an {email|k.mueller (at) firma (dot) de} senden!
email {email|sales @ acme . com} for a quote
Ask {email|peter.van.dyk [at] research [dot] lab [dot] example [dot] edu} about it.
reach us: {email|info(at)shop24(dot)fr}; or come by
{email|webmaster [AT] site [DOT] org} is the one to tell.
Send it to {email|bob@example [dot] com} or to me
The list owner is {email|list-owner[at]lists.example.org}.
écrivez à {email|claire.dupont (at) exemple (dot) fr} s'il vous plaît
The machine at {ip|10[.]0[.]0[.]1} went down.
Traffic from {ip|192 . 168 . 1 . 20} was dropped
block {ip|203[.]0[.]113[.]77} now
C2 host {ip|198(.)51(.)100(.)23} seen twice
seen on {ip|172[dot]16[dot]254[dot]3} last week
pay with {card|4111.1111.1111.1111} please
card {card|5500.0000.0000.0004}, exp 09/27
He read out {card|4012 - 8888 - 8888 - 1881} over the phone.
old card: {card|4222.2222.2222.2220} (closed)
Visa {card|4539/1488/0343/6467} was declined
Call {phone|(212) 555-0123} after six.
tel. {phone|212-555-0199}
Phone: {phone|415.555.2671} or {phone|415 555 2672}
Fax {phone|0049 30 1234567}
ring {phone|(020) 7946 0958} in office hours
Tél. {phone|01 23 45 67 89}
mobile {phone|0171 2345678}
Her number is {phone|(650)555-7788}.
contact desk {phone|800-555-0175}, weekdays only
Appelez le {phone|06 12 34 56 78} le matin
office: {phone|(415) 555-0101}
serial 555 123 4567 is stamped on the back
order no. 20240117-3345 was shipped
The file has 1,234,567.89 rows and 12 columns.
Published 2023-10-03, pages 101-117.
version 2.14.3 came out in 2021
ISBN 978-3-16-148410-0
They met (at) the station and left.
we sat [at] the table, dot by dot
Room 12, floor 3, at 10:30
sha1 da39a3ee5e6b4b0d3255bfef95601890afd80709
ratio 16:9, size 1920x1080
invoice 4929 1234 5678 9012 was lost
Between 1914-1918 many left.
see section 4.2.1.7b for more
the price went from 100 - 200 to 300 - 400
@maria and @john said so
item 00123-4567 [1] and [2]
In 1999 (at) best 20 people came.
id 9876543210 was removed
lat 52.5200, lon 13.4050
"""


def marked(line):
    text, spans, at = "", set(), 0
    for m in re.finditer(r"\{(\w+)\|([^}]*)\}", line):
        text += line[at : m.start()]
        spans.add((P.KINDS.index(m[1]), len(text), len(text) + len(m[2])))
        text, at = text + m[2], m.end()
    return text + line[at:], spans


def test_spans_written_by_hand(tagger):
    lines = [marked(line) for line in GOLD.strip().split("\n")]
    texts = [text for text, _ in lines]
    found = P.added(tagger, texts, [P.by_rules(text) for text in texts])
    right = sum(len(set(f) & want) for f, (_, want) in zip(found, lines))
    assert right / sum(len(want) for _, want in lines) >= 0.9
    assert right / sum(map(len, found)) >= 0.9


def test_long_rows_of_digits():
    for text in ("0" * 5000 + ".1.1.1", "1.1.1." + "0" * 5000 + "7", "9" * 9000 + ".1.1.1", "4" * 5000):
        got = [(P.KINDS[k], s, e) for k, s, e in P.by_rules(text)]
        assert got == ([("ip", 0, len(text))] if text[0] in "01" else [])
        assert P.settled(1, 0, len(text), text) is None or text[0] in "01"


def test_windows_cover_all_anchors():
    text = ("x" * 200 + "5" * 300 + "y" * 500 + "@" + "z" * 10) * 2
    starts = P.windows_of(text)
    covered = set().union(*(range(s, s + P.WINDOW) for s in starts))
    for m in re.finditer("[0-9@]", text):
        assert set(range(max(0, m.start() - P.REACH), min(len(text), m.end() + P.REACH))) <= covered
    assert P.windows_of("no such thing") == []


class Marker:
    """Marks what a pattern finds in the windows' characters."""

    def __init__(self, kind, pattern):
        self.kind, self.pattern = kind, re.compile(pattern)

    def decode(self, ids, lean):
        out = np.zeros(ids.shape, np.int64)
        for row, own in zip(out, ids):
            for m in self.pattern.finditer("".join(chr(c + 30) if c else "\n" for c in own)):
                row[m.start()] = 2 * self.kind + 1
                row[m.start() + 1 : m.end()] = 2 * self.kind + 2
        return out


def test_spans_over_a_windows_edge_are_joined():
    long = "ann.smith [at] department [dot] informatics [dot] university [dot] example [dot] org", "a" * 70 + " [at] " + "b" * 120 + " [dot] org", "x" * 45 + "[at]host[dot]org"
    for item in long:
        for before in range(0, 130, 7):
            text = "!" * before + item + "!" * 130
            assert P.added(Marker(0, r"[\w.\[\] ]+"), [text], [[]]) == [[(0, before, before + len(item))]], (item, before)


def test_phones_of_other_countries():
    for text in ("0049 30 1234567", "030 12345678", "0044 (20) 7946 0958", "(212) 555-0123", "01 23 45 67 89"):
        assert P.plausible(3, text)
    for text in ("123-4567", "1234567890123456", "12345678x"):
        assert not P.plausible(3, text)


def test_kinds_are_settled_by_their_characters():
    assert P.settled(1, 0, 19, "4111.1111.1111.1111") == (2, 0, 19)
    assert P.settled(2, 0, 13, "415 555 2672.") == (3, 0, 12)
    assert P.settled(0, 2, 18, "x ann@b [dot] org.") == (0, 2, 17)
    assert P.settled(3, 0, 5, "12345") is None


def test_overlapping_spans_are_reconciled():
    assert P.reconciled([(0, 0, 10), (1, 5, 30), (0, 31, 40), (0, 0, 10)], [(2, 33, 34)]) == [(1, 5, 30)]
    assert sorted(P.reconciled([(0, 0, 10), (1, 9, 12), (3, 12, 20)], [])) == [(0, 0, 10), (3, 12, 20)]


def test_rows(spark, tagger):
    texts = ["é bob@example.com", None, "", "no data", "call (212) 555-0123 or bob [at] mail [dot] org now", "10.0.0.1 " * 300 + "x" * 50000]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in [*enumerate(texts), (0, texts[0])]], "doc_id long, text string, n_email int, spans string")
    rows = [r.asDict() for r in P.find(docs, tagger).collect()]
    assert len(rows) == 7
    for r in rows:
        text = texts[r["doc_id"]] or ""
        base = P.by_rules(text)
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(x[0] == i for x in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{P.KINDS[k]}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert set(filter(None, P.written(base).split(","))) <= set(r["spans"].split(","))
    assert [r["spans"] for r in rows if r["doc_id"] == 0][0] == "email:2:17"
    assert "phone:5:19" in [r["spans"] for r in rows if r["doc_id"] == 4][0]
    assert P.find_all(docs.where("false")).count() == 0
