import random

import numpy as np
import pyarrow as pa

from vellum.llm import lm_score as M
from vellum.llm.arrowtext import text_slices


def test_gradient_step_and_probabilities():
    net = M.Network.first(np.random.default_rng(0).random(M.CLASSES))
    context = np.random.default_rng(1).integers(0, M.CLASSES + 1, (2, 2 * M.REACH)).repeat(M.CLASSES, 0)
    logs = net.log_probabilities(context, np.tile(np.arange(M.CLASSES), 2))
    assert np.allclose(np.exp(logs).reshape(2, -1).sum(1), 1, atol=1e-4)
    target = np.array([3, 900])
    before = net.log_probabilities(context[[0, -1]], target).sum()
    squares = M.Network(np.full(M._SIZE, 0.01, np.float32))
    for _ in range(20):
        net.step(context[[0, -1]], target, squares)
    assert net.log_probabilities(context[[0, -1]], target).sum() > before + 1


def test_scores_by_hand(spark):
    texts = ["the cat sat on the mat", "The CAT", "", None, "x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    frequent, counts = M.vocabulary(docs)
    assert counts.sum() == 9 and counts[0] == 3
    net = M.Network.first(counts)
    for row in M.score(docs, net.values, frequent).collect():
        words = (texts[row.doc_id] or "").lower().split()
        assert row.n_tokens == len(words)
        for _, _, data, offsets in text_slices(pa.array([" ".join(words)])):
            ids = M.classes_of(data, offsets, frequent)[0].tolist()
        total = 0.0
        for t in range(len(words)):
            around = [ids[t + j] if 0 <= t + j < len(ids) else M.CLASSES for j in (-2, -1, 1, 2)]
            total += float(net.log_probabilities(np.array([around]), np.array([ids[t]]))[0])
        assert abs(row.log_likelihood - total) < 1e-3
        assert (row.mean_log_likelihood is None) == (not words)


def test_training_beats_shares_and_prefers_order(spark):
    rng = random.Random(0)
    chains = [["w%d" % ((7 * i + j * j) % 40) for j in range(6)] for i in range(12)]
    texts = [" ".join(w for _ in range(60) for w in rng.choice(chains)) for _ in range(1500)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    frequent, counts = M.vocabulary(docs)
    plain = M.score(docs, M.Network.first(counts).values, frequent).agg({"log_likelihood": "sum"}).first()[0]
    net, frequent = M.train(docs, rounds=3)
    learned = M.score(docs, net, frequent).agg({"log_likelihood": "sum"}).first()[0]
    assert learned > 0.9 * plain
    mixed = [(i, " ".join(rng.sample(t.split(), len(t.split())))) for i, t in enumerate(texts)]
    assert learned > M.score(spark.createDataFrame(mixed, "doc_id long, text string"), net, frequent).agg({"log_likelihood": "sum"}).first()[0]


def test_every_token_is_a_target_once():
    firsts = np.array([0, 1, 3, 3, 20, 57])
    for rounds in (1, M.ROUNDS, 3):
        assert sorted(np.concatenate([M.masked(firsts, turn, rounds) for turn in range(rounds)])) == list(range(57))


def test_short_texts_train(spark):
    for text in ("word", "two words"):
        docs = spark.createDataFrame([(i, text) for i in range(50)], "doc_id long, text string")
        net, frequent = M.train(docs)
        assert not np.array_equal(net, M.Network.first(M.vocabulary(docs)[1]).values)


def test_words_of_a_class_score_apart(spark, monkeypatch):
    texts = [" ".join(f"f{i}" for i in range(M.FREQUENT))] * 9 + ["rare%d " % (i % 400 if i % 2 else 0) for i in range(800)] + ["rare0 rare0 rare1 once"]
    docs = spark.createDataFrame([*enumerate(texts), (-1, None), (-1, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "rare0 rare0 rare1 once"), (1, "neverseen"), (1, "neverseen"), (2, "f1 f2")], "doc_id long, text string")
    words = M.stored(M.word_counts(docs), "words")
    frequent, counts = M.vocabulary(docs, words=words)
    net = M.Network.first(counts).values
    table, number = {r.word: r["count"] for r in words.collect()}, M.OTHERS - 1
    own = set(frequent[0].view(np.int64).tolist())
    size = lambda c: M.SMOOTH + sum(n + M.SMOOTH for w, n in table.items() if w not in own and w & number == c)
    plain = {r.doc_id: r.log_likelihood for r in M.score(asked, net, frequent).collect()}
    want = dict(plain)
    for doc, text in ((0, "rare0 rare0 rare1 once"), (1, "neverseen")):
        for _, _, data, offsets in text_slices(pa.array([text])):
            starts, ends, _ = M.word_spans(data, offsets)
            for w in M.span_hashes(data, starts, ends).view(np.int64).tolist():
                if w not in own:
                    want[doc] += np.log((table.get(w, 0) + M.SMOOTH) / size(w & number))
    assert want[0] < plain[0] and want[2] == plain[2]
    for known in (0, 200, M.KNOWN):  # from the join, from both, from the counts that go out
        monkeypatch.setattr(M, "KNOWN", known)
        found = M.score(asked, net, frequent, words=words).collect()
        assert len(found) == 4 and all(abs(r.log_likelihood - want[r.doc_id]) < 1e-6 for r in found)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert M.score_all(none).count() == 0
    blank = spark.createDataFrame([(1, None), (1, None), (None, " ")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in M.score_all(blank).collect()) == [0, 0, 0]


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD", 300)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first, second = ({r.doc_id: r.log_likelihood for r in M.score_all(rows).collect()} for rows in (docs.repartition(2), docs.repartition(7, "text")))
    assert len(first) == 1000 and all(abs(first[k] - second[k]) <= 1e-9 * abs(first[k]) for k in first)


def test_clashing_names_and_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000, 1, 2, "x"), (1, "word", 1, 2, "y")], "doc_id long, text string, key int, n_tokens int, words string")
    assert sorted(r.n_tokens for r in M.score_all(docs).collect()) == [1, 400_000]
