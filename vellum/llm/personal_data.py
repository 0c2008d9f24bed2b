"""Personal data in texts: rules for the plain forms, a learned tagger for the written-around ones.

Rules find e-mail addresses, IP addresses, payment cards and phone numbers in their plain forms. A
character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans, adds
spans of the same kinds that the rules cannot see: ``name [at] host [dot] org``, ``10[.]0[.]0[.]1``,
``(212) 555-0123`` or cards parted by dots. Its labelled spans are the rules' own finds in a bounded
sample of documents, and written-around forms set into the same surroundings (``TRAINING`` examples).

Whatever the tagger may add has a digit, an at sign or a bracketed "at" in it, so text farther than
``REACH`` characters from all of these can hold none, and windows are laid over the rest: ``WINDOW``
characters, half a window apart. Windows overlap; where a span touches a window's edge one more window is
laid across the edge if there is none, and its parts are joined. The windows' spans of a text are reconciled globally: those that overlap
a rule's find go, and of spans that overlap each other the set of greatest total length stays.

A span's kind and end are settled by its characters: signs at its end are left off, and a row of digits that
passes Luhn is a card, whatever kind of number was marked. On sentences written by hand, not by the generator
of its training set (``tests/llm``), the tagger finds over nine in ten written-around forms, and over nine in
ten of what it marks are right.

Null texts are empty. Rows that repeat are searched each. Of spans of equal length that overlap the first one
stays. Very long texts and runs of digits take a time in proportion to their length. Columns beside id and
text are not read, whatever their names. An empty table gives no rows; the tagger is then trained on built-in
surroundings. The sample for the training surroundings is bounded; every text is searched whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.sequence_tagger import Tagger, spans_of

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, and how far from a digit or at sign a span can reach.
WINDOW, REACH = 96, 40
#: Windows that are decoded at once.
DECODED = 2048
#: Examples of the training set, and documents that their surroundings are taken from at most.
TRAINING, SAMPLE = 6000, 300
#: What is added to the score of a character in a span when windows are decoded.
LEAN = 0.15

#: The rules. EMAIL is found by its at signs and IP from the start of a run of digits,
#: which gives the same leftmost matches in a time that does not grow with the square of a run.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[\[(] ?(?:[aA][tT]|[dD][oO][tT]) ?[\])]")


def luhn(digits: str) -> bool:
    """Whether a row of digits has the right last one."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Places of e-mail addresses, leftmost first."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (host := _HOST.match(text, at + 1)):
            end = host.end()
            yield start, end
        at = text.find("@", at + 1)


def by_rules(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the plain forms, by kind, then start."""
    out = [(0, start, end) for start, end in emails(text)]
    for m in IP.finditer(text):
        if all(len(bare := x.lstrip("0")) <= 3 and int(bare or "0") <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def plausible(kind: int, text: str) -> bool:
    """Whether what the tagger marked can be of its kind at all."""
    digits = re.sub("[^0-9]", "", text)
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+ ?(?:@|[\[(] ?at ?[\])]) ?[\w-]+(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[\w-]+)+", text, re.IGNORECASE | re.ASCII))
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and bool(re.fullmatch(r"[0-9]+(?: ?(?:\.|[\[(]\.?(?:dot)?[\])]) ?[0-9]+){3}", text))
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 and bool(re.fullmatch(r"\+?\(?[0-9]++\)?(?:[ ./-]{0,3}\(?[0-9]++\)?)*", text))


def settled(kind: int, start: int, end: int, text: str) -> tuple[int, int, int] | None:
    """What the tagger marked, without signs at its end and of the kind that its characters allow: its own, else another of numbers; None if there is none."""
    while end > start and not text[end - 1].isalnum():
        end -= 1
    own = text[start:end]
    for other in (kind, *(k for k in (2, 1, 3) if kind and k != kind)):
        if plausible(other, own):
            return other, start, end
    return None


def character_ids(text: str) -> np.ndarray:
    """Classes of characters: printable ASCII each, other letters, other characters; 0 is none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((points >= 32) & (points < 127), points - 30, np.where(points < 32, 1, np.where(points >= 0xC0, 97, 98))).astype(np.uint8)


CHARACTERS = 99


#: Words that made-up names are put together from, and words before a number that make it a phone's, or none.
_SYLLABLES = "an ber cla da el fra go hu in jo ka lo ma no ol pe ra sa ti ul va wi xe yo zu th er on st".split()
_PARTS = "info mail john smith maria sales support team lab uni shop list web office anna peter group press".split()
_PHONES = "call phone tel. fax mobile ring contact office".split()
_NUMBERS = "serial order invoice item id ref model lot no. number ISBN code ticket case".split()


#: Kinds as they are drawn: 4 is none.
_DRAWN = (0, 0, 1, 2, 3, 3, 4, 4)


def written_around(rng: np.random.Generator, kind: int) -> tuple[str, str, bool]:
    """Words before, and a made-up item of a kind, plain or written around, or something alike that is none."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *x: x[rng.integers(len(x))]
    name = lambda: pick(pick(*_PARTS), "".join(pick(*_SYLLABLES) for _ in range(rng.integers(1, 5))), chr(97 + rng.integers(26)))
    if kind == 0:
        at = pick("@", " [at] ", "[at]", " (at) ", "(at)", " @ ", " [AT] ", "(AT)")
        round_ones = "(" in at or (at == "@" and rng.random() < 0.5)
        dot = pick(".", *((" (dot) ", "(dot)", " (DOT) ") if round_ones else (" [dot] ", "[dot]", " [DOT] ")), " . " if at == " @ " else ".")
        local = name() + "".join(pick(".", "_", "-", ".") + pick(name(), digits(2)) for _ in range(pick(0, 0, 1, 1, 2))) + pick("", "", digits(rng.integers(1, 4)))
        host = name() + pick("", "", "-" + name(), digits(rng.integers(1, 3)))
        labels = [host, *(name() for _ in range(pick(0, 0, 1, 2, 3))), pick("com", "org", "net", "de", "fr", "es", "edu", "io", "co" + dot + "uk")]
        return "", local + at + dot.join(labels), True
    if kind == 1:
        return "", pick(".", "[.]", "(.)", " . ", "[dot]", "(dot)", "[.]").join(str(x) for x in (rng.integers(0, 256, 4) if rng.random() < 0.7 else rng.integers(0, 20, 4))), True
    if kind == 2:
        body = [pick(4, 5, 6), *rng.integers(0, pick(1, 10, 10), 14)]
        body.append((10 - sum((x * 2 - 9 * (x > 4)) if i % 2 == 0 else x for i, x in enumerate(body)) % 10) % 10)
        whole, part = "".join(map(str, body)), pick("", " ", "-", ".", ".", " - ", "/", "  ")
        return pick("", "", "card "), part.join(whole[i : i + 4] for i in range(0, 16, 4)), True
    if kind == 3:
        a, b, c, two = digits(3), digits(3), digits(4), lambda n: " ".join(digits(2) for _ in range(n))
        before = pick("", "", *(w + pick(" ", ": ") for w in _PHONES))
        plain = pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"{a} {b} {c}")
        other = pick(f"00{digits(2)} {digits(2)} {digits(7)}", f"00{digits(2)} ({digits(2)}) {digits(4)} {c}", f"(0{digits(2)}) {c} {digits(4)}", f"0{digits(3)} {digits(7)}", f"0{digits(1)} {two(4)}", f"0{digits(2)} {digits(8)}")
        return before, plain if rng.random() < 0.6 else other, True
    groups = pick(" ", "-", ".").join(digits(rng.integers(2, 5)) for _ in range(rng.integers(2, 6)))
    return "", pick(
        pick(*_NUMBERS) + pick(" ", " ", ": ") + pick(groups, digits(rng.integers(4, 17)), f"{digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"),
        digits(rng.integers(1, 13)), f"v{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}.{digits(1)}{pick('a', 'b', 'rc1')}", f"{pick('1', '20')}{digits(2)}-0{digits(1)}-1{digits(1)}", f"19{digits(2)}-19{digits(2)}", f"{digits(2)}.{digits(2)}.20{digits(2)}",
        f'token = "{hashlib.md5(digits(5).encode()).hexdigest()}"', f"{digits(1)},{digits(3)}.{digits(2)}", f"{digits(3)} - {digits(3)}", f"@{name()}", f"[{digits(1)}]", f"10:{digits(2)}", f"{digits(2)}.{digits(4)}, {digits(2)}.{digits(4)}", f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
        f"{name()} {pick('(at)', '[at]', '@')} {name()} {name()}", f"{name()} (at) the {name()}", f"{digits(3)}x{digits(3)}",
    ), False


def examples(texts: list[str], n: int = TRAINING, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows of characters and their labels: items set into surroundings from ``texts``."""
    rng = np.random.default_rng(seed)
    filler = " ".join(texts)[: 1 << 20] if texts else ""
    filler = re.sub(r"[0-9@\[\]()+]", "", filler) or "of the and they were to come back there when it was over, or so we said. Then others "
    filler *= -(-4 * WINDOW // len(filler))
    ids, gold = np.zeros((n, WINDOW), np.uint8), np.zeros((n, WINDOW), np.int64)
    for row in range(n):
        text, marks = "", []
        while len(text) < 2 * WINDOW:
            at = int(rng.integers(0, len(filler) - WINDOW))
            text += filler[at : at + int(rng.integers(0, rng.choice([3, 20, WINDOW])))] + str(rng.choice([" ", " ", " ", "\n", ", ", ": ", " (", "; "]))
            kind = int(rng.choice(_DRAWN))
            before, item, is_one = written_around(rng, kind)
            text += before
            if is_one:
                marks.append((kind, len(text), len(text) + len(item)))
            text += item + str(rng.choice([" ", " ", " ", ". ", ", ", "\n", "!! ", "### ", "; ", ": ", ") ", "? "]))
        first = int(rng.choice([0, rng.integers(0, WINDOW)]))
        last = min(len(text), first + int(rng.choice([WINDOW, rng.integers(WINDOW // 2, WINDOW)])))
        own = character_ids(text[first:last])
        ids[row, : len(own)] = own
        for kind, start, end in marks:
            start, end = max(start, first) - first, min(end, last) - first
            if start < end:
                gold[row, start] = 2 * kind + 1
                gold[row, start + 1 : end] = 2 * kind + 2
    return ids, gold


def train(texts: list[str], n: int = TRAINING) -> Tagger:
    """A tagger whose training examples have their surroundings from ``texts``; the rules' finds in these are examples too."""
    ids, gold = examples(texts, n)
    more_ids, more_gold = [], []
    for text in texts:
        for kind, start, end in by_rules(text):
            first = max(0, min(start, start - (WINDOW - (end - start)) // 2))
            if end - first > WINDOW:
                continue
            own, labels = np.zeros(WINDOW, np.uint8), np.zeros(WINDOW, np.int64)
            part = character_ids(text[first : first + WINDOW])
            own[: len(part)] = part
            for k, a, b in by_rules(text[first : first + WINDOW]):
                labels[a] = 2 * k + 1
                labels[a + 1 : b] = 2 * k + 2
            more_ids.append(own)
            more_gold.append(labels)
    if more_ids:
        ids, gold = np.concatenate([ids, more_ids[: n // 2]]), np.concatenate([gold, more_gold[: n // 2]])
    tagger = Tagger(CHARACTERS, len(KINDS))
    tagger.train(ids, gold)
    return tagger


def windows_of(text: str) -> list[int]:
    """Starts of the windows of a text: they cover all that is near a digit, an at sign or a bracketed at."""
    out, reached = [], -1
    for m in _ANY.finditer(text):
        first = max(0, m.start() - REACH)
        last = min(len(text), m.end() + REACH)
        if last <= reached:
            continue
        start = first if not out or first > reached else max(out[-1] + WINDOW // 2, 0)
        while True:
            out.append(start)
            reached = start + WINDOW
            if reached >= last:
                break
            start += WINDOW // 2
    return out


def reconciled(found: list[tuple[int, int, int]], rules: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of the windows' spans, those that overlap no rule's find, and of each other the set of greatest total length."""
    taken = sorted((s, e) for _, s, e in rules)
    free = sorted({x for x in found if not any(s < x[2] and x[1] < e for s, e in taken)}, key=lambda x: (x[2], x[1], x[0]))
    best: list[tuple[int, list]] = [(0, [])]
    ends: list[int] = []
    for x in free:
        before = int(np.searchsorted(ends, x[1], side="right"))
        take = (best[before][0] + x[2] - x[1], [best[before][1], x])
        best.append(max(best[-1], take, key=lambda b: b[0]))
        ends.append(x[2])
    out, node = [], best[-1][1]
    while node:
        out.append(node[1])
        node = node[0]
    return out


def joined(parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Parts of a kind that overlap or touch, as one span each."""
    out: list[tuple[int, int, int]] = []
    for kind, start, end in sorted(parts):
        if out and out[-1][0] == kind and start <= out[-1][2]:
            out[-1] = kind, out[-1][1], max(out[-1][2], end)
        else:
            out.append((kind, start, end))
    return out


def added(tagger: Tagger, texts: list[str], rules: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """For each text the spans that the tagger adds to the rules' finds."""
    places = [(i, start) for i, text in enumerate(texts) for start in windows_of(text)]
    laid = set(places)
    found: list[list] = [[] for _ in texts]
    parts: list[list] = [[] for _ in texts]
    first = 0
    while first < len(places):  # windows across edges are added while others are decoded
        some = places[first : first + DECODED]
        first += len(some)
        ids = np.zeros((len(some), WINDOW), np.uint8)
        for row, (i, start) in enumerate(some):
            own = character_ids(texts[i][start : start + WINDOW])
            ids[row, : len(own)] = own
        labels = tagger.decode(ids, LEAN)
        for row in np.flatnonzero((labels > 0).any(axis=1)):
            i, start = some[row]
            for kind, a, b in spans_of(labels[row]):
                before, behind = a == 0 and start > 0, b == WINDOW and start + b < len(texts[i])
                if before or behind:
                    parts[i].append((kind, start + a, start + b))
                    for other in [max(0, start - WINDOW // 2)] * before + [start + WINDOW // 2] * behind:
                        if (i, other) not in laid:
                            laid.add((i, other))
                            places.append((i, other))
                elif start + b <= len(texts[i]) and (one := settled(kind, start + a, start + b, texts[i])):
                    found[i].append(one)
    for text, own, cut in zip(texts, found, parts):
        own += [one for x in joined(cut) if (one := settled(*x, text))]
    return [reconciled(f, r) for f, r in zip(found, rules)]


def written(spans: list[tuple[int, int, int]]) -> str:
    """Spans as kind:start:end by kind, then start, joined by commas."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def training_texts(docs: DataFrame, text_column: str = "text") -> list[str]:
    """At most ``SAMPLE`` pieces of texts with a digit or at sign, in the order of their hashes."""
    text = F.col(text_column).cast("string")
    at = F.regexp_instr(text, F.lit("[0-9@]"))
    near = F.substring(text, F.greatest(F.lit(1), at - 300), F.lit(600))
    rows = docs.where(at > 0).select(near.alias("text")).withColumn("draw", F.xxhash64("text"))
    # the smallest hashes first, so that copies do not fill the sample
    draws = [r.draw for r in rows.select("draw").distinct().orderBy("draw").limit(SAMPLE).collect()]
    chosen = rows.where(F.col("draw").isin(draws)).groupBy("draw").agg(F.min("text").alias("text"))
    return [r.text for r in sorted(chosen.collect())]


def find(docs: DataFrame, tagger: Tagger, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: its id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` and ``base_sha256`` of the rules' finds, and ``spans``, these and the tagger's."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for batch in source:
            n = batch.num_rows
            counts, digests, spans = np.zeros((n, 4), np.int64), [none] * n, [""] * n
            hit = [i for i, x in enumerate(batch.column(2).to_pylist()) if x]
            for first in range(0, len(hit), 256):
                rows = hit[first : first + 256]
                texts = [batch.column(1)[i].as_py() for i in rows]
                base = [by_rules(t) for t in texts]
                for i, rules, more in zip(rows, base, added(tagger, texts, base)):
                    for kind, *_ in rules:
                        counts[i, kind] += 1
                    digests[i] = hashlib.sha256(written(rules).encode()).hexdigest()
                    spans[i] = written(rules + more)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(counts[:, k]) for k in range(4)], pa.array(digests), pa.array(spans)], ["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    # without a digit, an at sign or a bracketed at, no rule and no learned form can be met
    may = text.rlike(r"[0-9@]|[\[(] ?[aA][tT] ?[\])]")
    columns = docs.select(docs[id_column].alias("id"), F.when(may, text).alias("text"), may.alias("may"))
    kind = columns.schema["id"].dataType.simpleString()
    return columns.mapInArrow(batches, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string").withColumnRenamed("id", id_column)


def find_all(docs: DataFrame) -> DataFrame:
    """Personal data of every row, by a tagger that is trained on surroundings from ``docs``."""
    return find(docs, train(training_texts(docs)))
