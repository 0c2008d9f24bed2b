"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are its byte 3-grams and 4-grams after folding (ASCII and Latin-1 letters to
lower case; digits, signs and white space to one space). Each is hashed to one of ``BUCKETS``
embeddings; their average is classified by a linear softmax. Embeddings and classifier are trained
together by stochastic gradient descent in numpy on a bounded sample of labelled rows: at most
``SAMPLE`` texts a language and about ``TOTAL`` in all, of a longer text ``SPREAD`` pieces of
``PIECE`` characters spread over the whole. Every language that a label names is learned. Part of the
sample is set aside to calibrate: a temperature makes scores probabilities, and two limits reject what
is unlike everything learned: the score, and the share of subwords that training saw, by a hash of
``SEEN`` places that does not fill up. Each limit lies between what all but ``REJECTED_SHARE`` of the
set-aside texts have, and what ``NEGATIVE`` of negatives stay below: the same texts as the other
languages see them, and with their letters shuffled. A share of few subwords says little, so it counts
with a margin that falls with their number; a text of fewer than ``FEW`` subwords is kept if it has a letter.

The trained tables have a fixed size for each language and travel with the tasks; every whole text is
read, a very long one as a slice of its own. Null texts and texts without a letter are ``und`` with
score 0 and rejected. Rows that repeat are predicted each; of languages that score the same the first by
name is taken; columns beside the id and the text are not read in prediction, whatever their names. With
no labelled row every text is ``und`` and only texts without a letter are rejected, as nothing is known
that others could be unlike. An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.arrowtext import task_memory, text_slices
from vellum.llm.pretokens import E, ENDING, LETTER, L, R, V, character_classes, code_points

BUCKETS, DIMENSIONS = 1 << 15, 16
#: Places of the hash that tells which subwords training saw; ``BUCKETS`` of them share an embedding.
SEEN = 1 << 20
FOLD = (SEEN // BUCKETS).bit_length() - 1
#: Labelled texts that the classifier is fitted on at most: of one language, and of all (one of each language at least).
SAMPLE, TOTAL = 400, 100_000
#: Characters of the pieces of a long text that are sampled, and their number; training cuts these into ``PIECES`` pieces besides using them whole.
PIECE, SPREAD, PIECES = 240, 24, 6
#: Passes over the sample, and steps at least, once more for every ``MORE`` languages: a small sample is passed over more often.
EPOCHS, STEPS, MORE, RATE, BATCH = 6, 600, 16, 0.5, 64
#: Subwords below which a text says too little to be rejected by either limit.
FEW = 8
REJECTED_SHARE, NEGATIVE = 0.0005, 0.95
#: Margin of a share of n subwords, times 1 / sqrt(n).
MARGIN = 1.5
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = ord(" ")
for _c in range(ord("a"), ord("z") + 1):
    _FOLD[_c] = _FOLD[_c - 32] = _c


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with letters in lower case and one value for all that are no letters in ASCII."""
    out = _FOLD[data]
    out[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] += 32
    return out


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (below ``SEEN``) of the subwords of a slice's texts, and where each text's begin; shifted by ``FOLD`` bits a place is a bucket.

    A subword over two texts' border, or of spaces mostly, goes to the place ``SEEN`` that counts for nothing.
    """
    n = len(data)
    x = np.concatenate([folded(data), np.full(4, 32, np.uint8)]).astype(np.uint32)
    out = np.empty((n, 2), np.int32)
    blank = x == 32
    gram = x[:n] * np.uint32(0x9E3779B1) ^ x[1 : n + 1] * np.uint32(0x85EBCA77) ^ x[2 : n + 2] * np.uint32(0xC2B2AE3D)
    for k, h in ((0, gram), (1, gram ^ x[3 : n + 3] * np.uint32(0x27D4EB2F))):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[:, k] = (h >> np.uint32(12)).astype(np.int32)
    out[blank[1 : n + 1] & (blank[:n] | blank[2 : n + 2])] = SEEN
    ends = offsets[1:]
    for i in range(1, 4):
        at = ends - i
        at = at[at >= 0]
        out[at, 1] = SEEN
        if i < 3:
            out[at, 0] = SEEN
    return out.reshape(-1), 2 * offsets


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text of a slice has a letter of any script."""
    points, at = code_points(data)
    kinds = character_classes()[points]
    letters = at[np.isin(kinds, (LETTER, ENDING, R, V, L, E))]
    return np.diff(np.searchsorted(letters, offsets)) > 0


@dataclass
class Model:
    """Log-odds of a subword for each language (embedding times classifier), and the calibration."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    seen: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0
    least_seen: float = 0.0

    def measured(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of each text of a slice, the share of its subwords that training saw, and their number."""
        places, firsts = subwords(data, offsets)
        rows, k = len(offsets) - 1, len(self.languages)
        logits, shares, counts = np.zeros((rows, k)), np.zeros(rows), np.zeros(rows, np.int64)
        full = np.flatnonzero(firsts[1:] > firsts[:-1])
        if len(full):
            counted = np.add.reduceat((places < SEEN).astype(np.int64), firsts[full])
            known = np.add.reduceat(self.seen[places].astype(np.int64), firsts[full])
            buckets = places >> FOLD
            for j in range(k):
                logits[full, j] = np.add.reduceat(self.table[j][buckets], firsts[full]) / np.maximum(counted, 1)
            shares[full] = known / np.maximum(counted, 1)
            counts[full] = counted
        return logits + self.bias, shares, counts

    def predicted(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score and whether it is rejected, for each text of a slice."""
        logits, shares, counts = self.measured(data, offsets)
        p = softmax(logits / self.temperature)
        score = p.max(axis=1)
        unseen = with_margin(shares, counts) < self.least_seen
        return p.argmax(axis=1), score, (counts >= FEW) & ((score < self.least_score) | unseen)


def with_margin(shares: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The highest share that one of so many subwords may stand for; more than 1 says nothing."""
    return shares + MARGIN / np.sqrt(np.maximum(counts, 1))


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts back to back, and their offsets."""
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def pieces_of(raw: bytes) -> list[bytes]:
    """A text and, if it is long, ``PIECES`` pieces of it, spread over the whole."""
    if len(raw) <= PIECE:
        return [raw]
    return [raw] + [raw[at : at + PIECE] for at in np.linspace(0, len(raw) - PIECE, min(PIECES, -(-len(raw) // PIECE))).astype(int)]


def train(texts: list[str], labels: list[str], seed: int = 1) -> Model | None:
    """A model of the languages in ``labels``; None if there is none."""
    languages = sorted({label for text, label in zip(texts, labels) if text.strip()})
    number = {name: i for i, name in enumerate(languages)}
    rng = np.random.default_rng(seed)
    pieces, targets, aside = [], [], []
    for text, label in zip(texts, labels):
        if not text.strip():
            continue
        held, cuts = rng.random() < 0.2, pieces_of(text.encode())
        pieces += cuts
        targets += [number[label]] * len(cuts)
        aside += [held] * len(cuts)
    if not pieces:
        return None
    targets, aside = np.array(targets), np.array(aside)
    if aside.all() or len(set(targets[~aside])) < len(set(targets)):
        aside[:] = False
    fit = np.flatnonzero(~aside)
    places, firsts = subwords(*_joined(pieces))
    own = [places[firsts[i] : firsts[i + 1]] for i in range(len(pieces))]
    own = [x[x < SEEN] for x in own]
    embedding, weights, bias = _descent([np.unique(x >> FOLD, return_counts=True) for x in own], targets, fit, len(languages), rng)
    seen_by = np.zeros(SEEN + 1, np.int32)  # languages that have a subword
    for language in range(len(languages)):
        seen_by[np.unique(np.concatenate([np.zeros(0, np.int32), *(own[i] for i in fit if targets[i] == language)]))] += 1
    model = Model(languages, np.ascontiguousarray((embedding @ weights).T), bias, seen_by > 0)
    _calibrate(model, [i for i in range(len(pieces)) if aside[i] or not aside.any()], pieces, own, targets, fit, seen_by, rng)
    return model


def _descent(counted: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, fit: np.ndarray, languages: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, classifier and its bias after stochastic gradient descent on the pieces in ``fit``."""
    embedding = rng.normal(0, 0.1, (BUCKETS + 1, DIMENSIONS)).astype(np.float32)
    embedding[BUCKETS] = 0
    weights, bias = np.zeros((DIMENSIONS, languages), np.float32), np.zeros(languages, np.float32)
    batches = -(-len(fit) // BATCH)
    epochs = max(EPOCHS, -(-STEPS * (1 + languages // MORE) // batches))
    steps, step = epochs * batches, 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for first in range(0, len(fit), BATCH):
            some = fit[first : first + BATCH]
            rate, step = RATE * (1 - step / steps), step + 1
            ids = np.concatenate([counted[i][0] for i in some])
            share = np.concatenate([counted[i][1] / max(counted[i][1].sum(), 1) for i in some]).astype(np.float32)
            which = np.repeat(np.arange(len(some)), [len(counted[i][0]) for i in some])
            own, at = np.unique(ids, return_inverse=True)
            shares = np.zeros((len(some), len(own)), np.float32)
            shares[which, at] = share
            means = shares @ embedding[own]
            error = softmax(means @ weights + bias)
            error[np.arange(len(some)), targets[some]] -= 1
            back = error @ weights.T
            weights -= rate * (means.T @ error) / len(some) * 8
            bias -= rate * error.mean(axis=0)
            embedding[own] -= rate * (shares.T @ back)
    return embedding, weights, bias


def _calibrate(model: Model, check: list[int], pieces: list[bytes], own: list[np.ndarray], targets: np.ndarray, fit: np.ndarray, seen_by: np.ndarray, rng: np.random.Generator) -> None:
    """Sets temperature and limits of ``model`` by the pieces in ``check``, and by negatives made of them."""
    logits, shares, counts = model.measured(*_joined([pieces[i] for i in check]))
    wanted = targets[check]
    # as in Platt's scaling a small share of each target goes to all languages, so that no sharpness fits a small set best
    rest = 1 / (len(wanted) + 2)

    def loss(t: float) -> float:
        logs = np.log(softmax(logits / t) + 1e-12)
        return -((1 - rest) * logs[np.arange(len(wanted)), wanted] + rest * logs.mean(axis=1)).mean()

    model.temperature = float(min(np.geomspace(0.02, 5, 60), key=loss))
    p = softmax(logits / model.temperature)
    # negatives: letters shuffled; and each language's texts as a model without that language would see them
    mixed = [bytes(rng.permutation(np.frombuffer(pieces[i], np.uint8))) for i in check]
    odd_logits, odd_shares, odd_counts = model.measured(*_joined(mixed))
    odd_scores = [softmax(odd_logits / model.temperature).max(axis=1)]
    odd_shares = [with_margin(odd_shares, odd_counts)]
    for language in range(len(model.languages)) if len(model.languages) > 1 else ():
        rows = np.flatnonzero(wanted == language)
        mine = np.zeros(SEEN + 1, bool)
        mine[np.concatenate([np.zeros(0, np.int32), *(own[i] for i in fit if targets[i] == language)])] = True
        other = (seen_by - mine) > 0
        known = np.array([other[own[check[r]]].mean() if len(own[check[r]]) else 0.0 for r in rows])
        odd_shares.append(with_margin(known, counts[rows]))
        odd_scores.append(softmax(np.delete(logits[rows], language, axis=1) / model.temperature).max(axis=1))
    right = (p.argmax(axis=1) == wanted) & (counts >= FEW)
    if right.any():
        model.least_score = min(0.5, _between(p.max(axis=1)[right], np.concatenate(odd_scores)))
        model.least_seen = _between(shares[right], np.concatenate(odd_shares))  # a text's margin falls to nothing, so positives count without


def _between(positive: np.ndarray, negative: np.ndarray) -> float:
    """A limit halfway between what all but ``REJECTED_SHARE`` of the positives reach and what ``NEGATIVE`` of the negatives do not; the former if they cross."""
    low, high = float(np.quantile(positive, REJECTED_SHARE)), float(np.quantile(negative, NEGATIVE))
    return (low + high) / 2 if high < low else low


def labelled_sample(docs: DataFrame, text_column: str, label_column: str, order_column: str) -> DataFrame:
    """At most about ``SAMPLE`` texts of each language and ``TOTAL`` of all, chosen by a hash of ``order_column``; of a longer text pieces of ``SPREAD * PIECE`` characters in all."""
    rows = docs.select(docs[text_column].cast("string").alias("text"), docs[label_column].cast("string").alias("label"), F.pmod(F.xxhash64(docs[order_column]), F.lit(1 << 40)).alias("draw"))
    rows = rows.where("text is not null and label is not null")
    counts = rows.groupBy("label").agg(F.count("*").alias("rows")).collect()  # a row a language
    each = min(SAMPLE, max(1, TOTAL // max(1, len(counts))))
    limits = F.from_json(F.lit(json.dumps({r.label: min(1.0, each / r.rows) for r in counts})), "map<string,double>")
    rows = rows.where(F.col("draw") < F.try_element_at(limits, F.col("label")) * (1 << 40))
    room = F.char_length("text") - PIECE
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SPREAD - 1)), lambda i: F.substring("text", (room * i / (SPREAD - 1)).cast("int") + 1, F.lit(PIECE))), "\n")
    return rows.select(F.when(F.char_length("text") > SPREAD * PIECE, spread).otherwise(F.col("text")).alias("text"), "label").limit(2 * SAMPLE * max(1, len(counts)))


def fit(docs: DataFrame, text_column: str = "text", label_column: str = "lang", order_column: str = "doc_id") -> Model | None:
    """A model learned from the labelled rows of ``docs`` (a bounded sample of them)."""
    rows = sorted(labelled_sample(docs, text_column, label_column, order_column).collect())
    return train([r.text for r in rows], [r.label for r in rows])


def identify(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: its id, ``lang_pred``, ``score`` and ``rejected``."""
    columns = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    kind = columns.schema["id"].dataType.simpleString()

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memory():
            for batch in source:
                for row, end, data, offsets in text_slices(batch.column(1)):
                    letters = has_letter(data, offsets)
                    if model is None:
                        names, score, rejected = np.full(end - row, UNKNOWN), np.zeros(end - row), np.zeros(end - row, bool)
                    else:
                        index, score, rejected = model.predicted(data, offsets)
                        names = np.array(model.languages)[index]
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(row, end - row),
                        pa.array(np.where(letters, names, UNKNOWN).tolist(), pa.string()),
                        pa.array(np.where(letters, score, 0.0), pa.float64()),
                        pa.array(rejected | ~letters),
                    ], ["id", "lang_pred", "score", "rejected"])

    return columns.mapInArrow(batches, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_column)


def accepted(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """``docs`` without the rows whose text the model rejects; all columns stay."""
    at = docs.columns.index(text_column)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memory():
            for batch in source:
                keep = np.zeros(batch.num_rows, bool)
                for row, end, data, offsets in text_slices(batch.column(at)):
                    keep[row:end] = has_letter(data, offsets)
                    if model is not None:
                        keep[row:end] &= ~model.predicted(data, offsets)[2]
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(batches, docs.schema)


def held_out(id_column: str = "doc_id"):
    """Whether a row is kept from training: the CRC of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Prediction for every row by a model that learns from the rows that are not held out."""
    model = fit(docs.where(~held_out()))
    found = identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
