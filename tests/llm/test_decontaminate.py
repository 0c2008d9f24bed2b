import random
import re

from vellum.llm import decontaminate as D


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs, items):
    found = set()
    for d, text in docs:
        own = shingles(text)
        for i, item in items:
            want = shingles(item)
            if want and 100 * len(own & want) >= 75 * len(want):
                found.add((d, i, len(want), len(own & want)))
    return found


def test_planted_items_as_by_brute_force(spark):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([1, 3, 5, 6, 14, 30, 59, 200])))) for i in range(60)] + [(90, None), (91, " "), (92, "Same  Words\nhere")]
    docs = []
    for d in range(150):
        text = say(rng.choice([0, 3, 40, 400, 3000]))
        for _ in range(rng.randrange(3)):
            item = (rng.choice(items[:60])[1]).split()
            if rng.random() < 0.4 and len(item) > 25:
                item[rng.randrange(len(item))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = item
        docs.append((d, " ".join(text)))
    docs += [(500, None), (501, ""), (502, "same words HERE"), (503, items[0][1])]
    left = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, item_id int").repartition(4)
    right = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 60
    assert {tuple(r)[:4] for r in D.contained_items(left, right).collect()} == want
    kept = D.without_items(left, right)
    assert kept.columns == left.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {w[0] for w in want}


def test_edges_of_the_input(spark):
    one = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    item = spark.createDataFrame([(7, "A b c d e f"), (7, "a b c d e f"), (None, "a b c d e f")], "item_id long, text string")
    assert [tuple(r) for r in D.contained_items(one, item).collect()] == [(1, 7, 2, 2, 1.0)]
    assert D.contained_items(one, item.where("false")).count() == 0
    assert D.contained_items(one.where("false"), item).count() == 0
    assert [r.doc_id for r in D.without_items(one, item).collect()] == [None]
