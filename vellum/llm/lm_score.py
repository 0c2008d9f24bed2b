"""Scores of texts by masked pseudo-likelihood of a bidirectional window network.

Tokens are words: the ``FREQUENT`` most frequent of the corpus by themselves, all others by a hash in
``OTHERS`` classes. A network predicts a masked token from ``REACH`` tokens on either side: embeddings by
place are summed, squashed, and give a softmax over groups of tokens and one over the members of the
group. A word of a hashed class then has its share of the class, log P(class) + log P(word | class): its
count in all texts by the class's, ``SMOOTH`` added for each of the class's words and once for all words
never counted. A text's score is the sum over all of its tokens of the log-probability given both sides.

The table of word counts grows with the input. Its most frequent words, ``KNOWN`` at most, go out with the
network; all others are summed up per text and joined with the table by their hashes.

Everything the model learns comes from all documents. Word counts are summed in each task before the
shuffle. Training is data-parallel over shards of about ``SHARD`` rows, ``SHARDS`` at most, dealt and ordered by a hash of id and
text (what is shuffled are the classes of tokens, two bytes each), and scores are computed in doubles, so that they do not
depend on how the input is split but for the last bits of sums. In each round every shard goes on from the same
parameters, and a share of its tokens is masked, other ones in each round, so that after the last round each
token of each text has been a target once. Then the shards' parameters are averaged by the number of tokens,
in salted groups, a block of parameters at a time and in the order of shards. What shards send grows with their
number, so with the input; what reaches the driver has the size of the model.

Null and empty texts have no tokens, score 0 and no mean. Rows that repeat are scored each (and count in
training as often). Without any token all scores are those of an untrained model; an empty table gives
no rows. Columns beside id and text are not read, whatever their names. Very long texts are slices of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.arrowtext import span_hashes, text_slices, word_spans
from vellum.llm.store import removed, stored

#: Words with a class of their own, classes of the others, and groups that the classes are dealt into.
FREQUENT, OTHERS, GROUPS = 768, 256, 32
CLASSES = FREQUENT + OTHERS
MEMBERS = CLASSES // GROUPS
#: Tokens seen on either side; size of the hidden layer.
REACH, HIDDEN = 2, 16
#: Rounds, which share the tokens out among them; tokens of a step; step size.
ROUNDS, BATCH, RATE = 2, 2048, 0.15
#: Rows of a shard, on average, and shards at most: beyond, a shard is as many rows as it takes.
SHARD, SHARDS = 4096, 1 << 14
#: Words whose counts go out with the network at most; what is added to a word's count within its class.
KNOWN, SMOOTH = 1 << 17, 0.5
#: Tokens that are scored at once: what they need stays in the processor's caches.
SCORED = 1 << 12
#: Parameters of a block, and groups that the tasks' parameters are summed in.
BLOCK, SUMMED = 4096, 16

_SHAPES = {"embed": (2 * REACH, CLASSES + 1, HIDDEN), "group": (HIDDEN, GROUPS), "group_b": (GROUPS,), "member": (GROUPS, HIDDEN, MEMBERS), "member_b": (GROUPS, MEMBERS)}
_SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())


class Network:
    """The parameters, as one vector and as views of its parts."""

    def __init__(self, values: np.ndarray):
        self.values, at = values, 0
        self.part = {}
        for name, shape in _SHAPES.items():
            n = int(np.prod(shape))
            self.part[name] = values[at : at + n].reshape(shape)
            at += n

    @classmethod
    def first(cls, counts: np.ndarray, seed: int = 4) -> Network:
        """An untrained network that gives each class its share of ``counts``."""
        net = cls(np.zeros(_SIZE, np.float32))
        rng = np.random.default_rng(seed)
        for name in ("embed", "group", "member"):
            net.part[name][:] = rng.normal(0, 0.1, _SHAPES[name])
        share = np.log((counts + 0.5) / (counts + 0.5).sum()).reshape(GROUPS, MEMBERS)
        total = np.logaddexp.reduce(share, axis=1)
        net.part["group_b"][:], net.part["member_b"][:] = total, share - total[:, None]
        return net

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """Hidden layer over (rows, places) classes of the context."""
        total = self.part["embed"][0][context[:, 0]]
        for j in range(1, 2 * REACH):
            total += self.part["embed"][j][context[:, j]]
        return np.tanh(total, out=total)

    @staticmethod
    def _by_group(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """An order of the rows by the group of their target, and where each group is in it."""
        group = (target // MEMBERS).astype(np.int16)  # numpy sorts 16 bits by radix
        edges = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=GROUPS))])
        return np.argsort(group, kind="stable"), [(g, slice(edges[g], edges[g + 1])) for g in range(GROUPS) if edges[g] < edges[g + 1]]

    def _members(self, h: np.ndarray, groups: list[tuple[int, slice]], target: np.ndarray) -> np.ndarray:
        """The members' outputs of rows in the order of their groups."""
        z = np.empty((len(h), MEMBERS), h.dtype)
        for g, rows in groups:
            np.matmul(h[rows], self.part["member"][g], out=z[rows])
        z += self.part["member_b"][target // MEMBERS]
        return z

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target class given its context."""
        h, every = self.hidden(context), np.arange(len(target))
        z = h @ self.part["group"]
        z += self.part["group_b"]
        out = z[every, target // MEMBERS]
        out -= _log_sum(z)
        order, groups = self._by_group(target)
        target = target[order]
        z = self._members(h[order], groups, target)
        member = z[every, target % MEMBERS]
        member -= _log_sum(z)
        out[order] += member
        return out

    def step(self, context: np.ndarray, target: np.ndarray, squares: Network) -> None:
        """One step of Adagrad against the targets' log-probability."""
        h, n, every = self.hidden(context), len(target), np.arange(len(target))
        p = _softmax(h @ self.part["group"] + self.part["group_b"])
        p[every, target // MEMBERS] -= 1
        back = p @ self.part["group"].T
        grads = {"group": h.T @ p / n, "group_b": p.sum(0) / n}
        member, member_b = np.zeros(_SHAPES["member"], np.float32), np.zeros(_SHAPES["member_b"], np.float32)
        order, groups = self._by_group(target)
        own, target = h[order], target[order]
        p = _softmax(self._members(own, groups, target))
        p[every, target % MEMBERS] -= 1
        further = np.empty_like(own)
        for g, rows in groups:
            np.matmul(p[rows], self.part["member"][g].T, out=further[rows])
            member[g], member_b[g] = own[rows].T @ p[rows] / n, p[rows].sum(0) / n
        back[order] += further
        grads |= {"member": member, "member_b": member_b}
        back *= (1 - h * h) / n
        for name, grad in grads.items():
            squares.part[name][:] += grad * grad
            self.part[name][:] -= RATE * grad / np.sqrt(squares.part[name] + 1e-8)
        for j in range(2 * REACH):
            column = context[:, j].astype(np.int16)
            order = np.argsort(column, kind="stable")
            column = column[order]
            first = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
            ids = column[first]
            grad = np.add.reduceat(back[order], first, axis=0)
            squares.part["embed"][j][ids] += grad * grad
            self.part["embed"][j][ids] -= RATE * grad / np.sqrt(squares.part["embed"][j][ids] + 1e-8)


def _log_sum(z: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials of each row; ``z`` is overwritten."""
    most = z.max(axis=1)
    z -= most[:, None]
    np.exp(z, out=z)
    return most + np.log(z @ np.ones(z.shape[1], z.dtype))


def _softmax(z: np.ndarray) -> np.ndarray:
    """Shares of the exponentials of each row; ``z`` is overwritten."""
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a slice's words, and where each text's begin."""
    starts, ends, firsts = word_spans(data, offsets)
    return span_hashes(data, starts, ends), firsts


def classified(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Classes of words. ``frequent``: sorted hashes and the classes of these words, in two rows."""
    out = (FREQUENT + hashes % np.uint64(OTHERS)).astype(np.int32)
    if frequent.shape[1]:
        at = np.minimum(np.searchsorted(frequent[0], hashes), frequent.shape[1] - 1)
        out = np.where(frequent[0][at] == hashes, frequent[1][at].astype(np.int32), out)
    return out


def classes_of(data: np.ndarray, offsets: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of a slice's tokens, and where each text's begin."""
    hashes, firsts = word_hashes(data, offsets)
    return classified(hashes, frequent), firsts


def contexts(classes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """(tokens, places) classes around each token; class ``CLASSES`` stands for places outside the text."""
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    out = np.full((len(classes), 2 * REACH), CLASSES, np.int32)
    for j, move in enumerate([*range(-REACH, 0), *range(1, REACH + 1)]):
        if len(classes) > abs(move):
            own, other = (slice(-move, None), slice(None, move)) if move < 0 else (slice(None, -move), slice(move, None))
            same = text[own] == text[other]
            out[own, j][same] = classes[other][same]
    return out


def masked(firsts: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """Tokens of a slice that are targets in round ``turn``; each is in one of ``rounds`` rounds."""
    counts = np.diff(firsts)
    place = np.arange(firsts[-1]) - np.repeat(firsts[:-1], counts)
    return np.flatnonzero((place + np.repeat(counts, counts)) % rounds == turn)


def word_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(word, count): hash of every word of all texts, and how often it occurs."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size = merged = 0
        for batch in source:
            for _, _, data, offsets in text_slices(batch.column(0)):
                waiting.append(np.unique(word_hashes(data, offsets)[0], return_counts=True))
                size += len(waiting[-1][0])
                if size > 2 * merged + (1 << 18):  # what a task holds is bounded, and merged seldom
                    waiting = [_summed(waiting)]
                    size = merged = len(waiting[0][0])
                    if merged > 1 << 20:
                        yield _counted(*waiting.pop())
                        size = merged = 0
        if waiting:
            yield _counted(*_summed(waiting))

    rows = docs.select(docs[text_column].cast("string").alias("text")).mapInArrow(batches, "word long, count long")
    return rows.groupBy("word").agg(F.sum("count").alias("count"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Words of several counts, and their sums."""
    words, at = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
    return words, np.bincount(at, np.concatenate([n for _, n in parts]), len(words)).astype(np.int64)


def _counted(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "count"])


def vocabulary(docs: DataFrame, text_column: str = "text", words: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and classes of the frequent words; and how often each class occurs in all texts (``words``: their stored counts)."""
    counted = stored(word_counts(docs, text_column), "words") if words is None else words
    top = counted.orderBy(F.desc("count"), "word").limit(FREQUENT).collect()
    counts = np.zeros(CLASSES)
    counts[: len(top)] = [r["count"] for r in top]
    hashes = np.array([r.word for r in top], np.int64).view(np.uint64)
    # the remainder of the hash as an unsigned number; OTHERS is a power of two
    rest = counted.groupBy(F.col("word").bitwiseAND(OTHERS - 1).alias("class")).agg(F.sum("count").alias("count"))
    for r in rest.collect():
        counts[FREQUENT + r["class"]] = r["count"]
    for h, r in zip(hashes, top):
        counts[FREQUENT + int(h) % OTHERS] -= r["count"]
    order = np.argsort(hashes)
    return np.stack([hashes[order], order.astype(np.uint64)]), counts


def tokenized(docs: DataFrame, frequent: np.ndarray, id_column: str | None, text_column: str) -> DataFrame:
    """(key, classes) of all rows, stored: a hash of id and text, and the classes of the text's tokens, two bytes each."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # ``FREQUENT`` words

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row, end, data, offsets in text_slices(batch.column(1)):
                classes, firsts = classes_of(data, offsets, shared.value)
                raw = pa.Array.from_buffers(pa.binary(), end - row, [None, pa.py_buffer((2 * firsts).astype(np.int32)), pa.py_buffer(classes.astype("<i2"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), raw], ["key", "classes"])

    text = docs[text_column].cast("string")
    key = F.xxhash64(text) if id_column is None else F.xxhash64(docs[id_column], text)
    return stored(docs.select(key.alias("key"), text.alias("text")).mapInArrow(batches, "key long, classes binary"), "tokens")


def sharded(tokens: DataFrame) -> DataFrame:
    """(classes) of all rows, in shards and an order that follow from the rows alone."""
    return tokens.repartition(max(1, min(SHARDS, -(-tokens.count() // SHARD))), "key").sortWithinPartitions("key").select("classes")


def classes_in(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Classes of a batch's texts back to back, and where each text's begin."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data.view("<i2").astype(np.int32), (offsets - offsets[0]) // 2


def _trained_round(shards: DataFrame, net: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """The parameters after one round of ``rounds`` over all texts: the shards' own, averaged by tokens."""
    start = shards.sparkSession.sparkContext.broadcast(net)  # of the model's size

    def tasks(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, squares, seen = Network(start.value.copy()), Network(np.full(_SIZE, 0.01, np.float32)), 0
        rest: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for batch in source:
            classes, firsts = classes_in(batch.column(0))
            some = masked(firsts, turn, rounds)
            rest.append((contexts(classes, firsts)[some], classes[some]))
            waiting += len(some)
            if waiting < BATCH:
                continue
            context, target = (np.concatenate(x) for x in zip(*rest))
            order = np.random.default_rng(waiting).permutation(len(target))
            context, target = context[order], target[order]
            full = len(target) // BATCH * BATCH
            for first in range(0, full, BATCH):
                own.step(context[first : first + BATCH], target[first : first + BATCH], squares)
            seen, waiting, rest = seen + full, len(target) - full, [(context[full:], target[full:])]
        if waiting:
            context, target = (np.concatenate(x) for x in zip(*rest))
            own.step(context, target, squares)
            seen += waiting
        if seen:
            shard = TaskContext.get().partitionId()
            padded = np.concatenate([own.values, np.zeros(-_SIZE % BLOCK, np.float32)]).reshape(-1, BLOCK)
            yield _blocks(np.arange(len(padded)), np.full(len(padded), shard), np.full(len(padded), float(seen)), padded * np.float32(seen))

    def summed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in source:
            for block, shard, weight, values in zip(*(batch.column(i) for i in range(4))):
                entry = total.setdefault((block.as_py(), shard.as_py() % SUMMED), [0.0, np.zeros(BLOCK)])
                entry[0] += weight.as_py()
                entry[1] += values.values.to_numpy()
        if total:
            yield _blocks(np.array([k[0] for k in total]), np.array([k[1] for k in total]), np.array([e[0] for e in total.values()]), np.stack([e[1] for e in total.values()]))

    schema = "block long, shard long, weight double, parameters array<float>"
    sums = shards.mapInArrow(tasks, schema).withColumn("salt", F.col("shard") % SUMMED).repartition("block", "salt").sortWithinPartitions("block", "shard")
    sums = sums.drop("salt").mapInArrow(summed, schema)
    out, weight = np.zeros((-(-_SIZE // BLOCK), BLOCK)), 0.0
    for row in sorted(sums.collect(), key=lambda r: (r.block, r.shard)):  # as many rows as blocks times ``SUMMED``
        out[row.block] += np.array(row.parameters)
        weight += row.weight * (row.block == 0)
    return (out.reshape(-1)[:_SIZE] / weight).astype(np.float32) if weight else net


def _blocks(block: np.ndarray, shard: np.ndarray, weight: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(values.astype(np.float32).reshape(-1))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1) * BLOCK, pa.int32()), flat)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(shard, pa.int64()), pa.array(weight, pa.float64()), lists], ["block", "shard", "weight", "parameters"])


def train(docs: DataFrame, text_column: str = "text", rounds: int = ROUNDS, words: DataFrame | None = None, id_column: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Parameters of a network that is trained on all texts, and the frequent words' hashes and classes. ``id_column`` spreads texts that are equal."""
    frequent, counts = vocabulary(docs, text_column, words)
    net = Network.first(counts).values
    tokens = tokenized(docs, frequent, id_column, text_column)
    shards = sharded(tokens)
    for turn in range(rounds):
        net = _trained_round(shards, net, turn, rounds)
    removed(docs.sparkSession, tokens)
    return net, frequent


def known_counts(words: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes and counts of the most frequent words, ``KNOWN`` at most; all words of the least count taken, or more, are there."""
    level = F.floor(F.log2("count") * 4).cast("int")
    sizes = sorted(words.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), reverse=True)
    least, total = None, 0
    for row in sizes:  # a few hundred rows at most
        total += row.words
        if total > KNOWN:
            break
        least = row.level
    rows = words.where(level >= least) if least is not None else words.where("false")
    taken = rows.select("word", "count").toArrow()
    hashes = taken.column("word").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], taken.column("count").to_numpy().astype(np.float64)[order]


def class_sizes(words: DataFrame, frequent: np.ndarray) -> np.ndarray:
    """Log of the smoothed count of each hashed class: of its words that have no class of their own."""
    rest = words.groupBy(F.col("word").bitwiseAND(OTHERS - 1).alias("class")).agg(F.sum("count").alias("count"), F.count("*").alias("words"))
    total = np.full(OTHERS, SMOOTH)
    for r in rest.collect():
        total[r["class"]] += r["count"] + SMOOTH * r.words
    own = words.where(F.col("word").isin([int(h) for h in frequent[0].view(np.int64)])) if frequent.shape[1] else words.where("false")
    for r in own.collect():  # ``FREQUENT`` rows at most
        total[r.word & (OTHERS - 1)] -= r["count"] + SMOOTH
    return np.log(total)


def score(docs: DataFrame, net: np.ndarray, frequent: np.ndarray, id_column: str = "doc_id", text_column: str = "text", words: DataFrame | None = None) -> DataFrame:
    """Per row: its id, ``n_tokens``, ``log_likelihood`` (the sum over tokens) and ``mean_log_likelihood``.

    ``words`` are the stored counts of all words; without them a word outside the frequent ones scores as its class.
    """
    table = None if words is None else (*known_counts(words), class_sizes(words, frequent))
    shared = docs.sparkSession.sparkContext.broadcast((net, frequent, table))  # of the model's size, and ``KNOWN`` counts

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, frequent, table = shared.value
        own = Network(values.astype(float))  # in singles a score would depend on the height of the arrays that its tokens are in
        key = TaskContext.get().partitionId() << 33
        for batch in source:
            for row, end, data, offsets in text_slices(batch.column(1)):
                own_hashes, firsts = word_hashes(data, offsets)
                classes = classified(own_hashes, frequent)
                around = contexts(classes, firsts)
                logs = np.empty(len(classes) + 1)
                logs[-1] = 0
                for at in range(0, len(classes), SCORED):
                    logs[at : min(at + SCORED, len(classes))] = own.log_probabilities(around[at : at + SCORED], classes[at : at + SCORED])
                counts = np.diff(firsts)
                text, hashes, times = within_class(own_hashes, classes, firsts, logs, table) if table else _NO_REST
                sums = np.where(counts > 0, np.add.reduceat(logs, firsts[:-1]), 0.0)
                edges = pa.array(np.searchsorted(text, np.arange(end - row + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (hashes.view(np.int64), times)]
                keys = pa.array(key + np.arange(end - row))
                key += end - row
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(counts, pa.int64()), pa.array(sums), keys, *lists], ["id", "n_tokens", "log_likelihood", "key", "words", "times"])

    columns = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    kind = columns.schema["id"].dataType.simpleString()
    found = columns.mapInArrow(batches, f"id {kind}, n_tokens long, log_likelihood double, key long, words array<long>, times array<long>")
    if words is not None:
        found = stored(found, "scored")
        rest = found.select("key", F.explode(F.arrays_zip("words", "times")).alias("rest")).select("key", F.col("rest.words").alias("word"), F.col("rest.times").alias("times"))
        # neither side has a bound
        logs = rest.join(words.hint("merge"), "word", "left").groupBy("key").agg(F.sum(F.col("times") * F.log(F.coalesce("count", F.lit(0)) + SMOOTH)).alias("more"))
        found = found.drop("words", "times").join(logs.hint("merge"), "key", "left")
        found = found.withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("more", F.lit(0.0)))
    return found.select(F.col("id").alias(id_column), "n_tokens", "log_likelihood", F.try_divide("log_likelihood", "n_tokens").alias("mean_log_likelihood"))


_NO_REST = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)


def within_class(words: np.ndarray, classes: np.ndarray, firsts: np.ndarray, logs: np.ndarray, table: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adds to ``logs`` what is known of log P(word | class); text, word and times of the words whose counts are not in ``table``."""
    hashes, counts, sizes = table
    at = np.flatnonzero(classes >= FREQUENT)
    own = words[at]
    logs[at] -= sizes[classes[at] - FREQUENT]
    there = np.zeros(len(at), bool)
    if len(hashes):
        place = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        there = hashes[place] == own
        logs[at[there]] += np.log(counts[place[there]] + SMOOTH)
    own, text = own[~there], np.searchsorted(firsts, at[~there], side="right") - 1
    order = np.lexsort((own, text))
    own, text = own[order], text[order]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])])) if len(own) else np.zeros(0, np.int64)
    return text[first], own[first], np.diff(np.append(first, len(own))).astype(np.int64)


def score_all(docs: DataFrame) -> DataFrame:
    """Scores of all rows by a network that is trained on them."""
    words = stored(word_counts(docs), "words")
    return score(docs, *train(docs, words=words, id_column="doc_id"), words=words)
