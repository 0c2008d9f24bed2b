import random

import pytest

from vellum.llm import line_dedup as D


def brute(rows, run_lines=3, run_words=50):
    """Later repeats of every window, found by looking at all earlier windows; windows of one distance that touch are one run, whose source stays."""
    seen, runs, cuts = {}, {}, {i: set() for i, _ in rows}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        lines = [(n, x.strip(" \t\n\r\x0b\x0c")) for n, x in enumerate((text or "").split("\n"))]
        lines = [x for x in lines if x[1]]
        for at in range(len(lines)):
            for size in range(1, run_lines + 1):
                own = lines[at : at + size]
                if len(own) < size or size < run_lines and sum(len(x.split()) for _, x in own) < run_words:
                    continue
                first, last = own[0][0], own[-1][0]
                j, source, end = seen.setdefault(tuple(x for _, x in own), (i, first, last))
                if (j, source) != (i, first):
                    for n in range(first, last + 1):
                        mine = runs.setdefault((i, j, first - source), {})
                        mine[n] = max(mine.get(n, -1), end)
    for (i, j, _), lines in runs.items():
        for n in lines:
            run = [n]
            while run[0] - 1 in lines:
                run.insert(0, run[0] - 1)
            while run[-1] + 1 in lines:
                run.append(run[-1] + 1)
            if i != j or n > max(lines[k] for k in run):
                cuts[i].add(n)
    return {i: t if t is None or i is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in cuts[i]) for i, t in rows}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_as_by_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = ["", " ", "x", "one two", " one two ", "a b c d", "z " * 50, "q " * 30, "r " * 25, "é\tü"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    rows += [(100, None), (101, "\n".join(["same"] * 3000)), (102, rows[5][1]), (103, rows[5][1] + "\n" + rows[6][1])]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, id int, start string").repartition(3)
    got = {r.doc_id: r.text for r in D.dedup_lines(docs).collect()}
    assert got == brute(rows)
    assert D.dedup_lines(docs).columns == docs.columns


def test_edges_of_the_input(spark):
    long = "w " * 60
    docs = spark.createDataFrame([(None, long), (None, long), (7, long), (7, long), (8, "top\n" + long + "\nend")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text, r.cut) for r in D.dedup_lines(docs, removed_column="cut").collect())
    assert got == [("7", long, 0)] * 2 + [("8", "top\nend", 1)] + [("None", long, 0)] * 2
    assert D.dedup_lines(docs.where("false")).count() == 0
    runs = D.repeated_runs(spark.createDataFrame([(1, "a\nb\nc\nd\ne"), (2, "x\na\nb\nc\nd\ny")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in runs] == [(2, 1, 4, 1, 0, 1)]


def test_rows_that_share_an_id_are_texts_of_their_own(spark):
    a, own = "a one\nb two\nc three", "q1\nq2\nq3\nq4\nq5"
    rows = [(1, a), (5, f"x\n{a}\ny"), (5, own), (5, own), (6, f"{own}\nend"), (None, a)]
    got = sorted((str(r.doc_id), r.text) for r in D.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    # rows that share id and text are one text, so neither is cut
    assert got == sorted([("1", a), ("5", "x\ny"), ("5", own), ("5", own), ("6", "end"), ("None", a)])
    rng = random.Random(9)
    rows = [(i % 7, "\n".join(f"{i} {k} {rng.random()}" for k in range(5))) for i in range(40)]
    assert sorted(map(tuple, D.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == sorted(rows)


@pytest.mark.parametrize(
    "text, want",
    [("a\na\na\na\na", "a\na\na"), ("x y\nq\nx y\nq\nx y\nz", "x y\nq\nx y\nz"), ("a\nb\n" * 5 + "c", "a\nb\na\nb\nc"), ("a\nb\nc\na\nb\nc", "a\nb\nc")],
)
def test_a_first_run_is_never_cut(spark, text, want):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert D.dedup_lines(docs).first().text == want


def test_names_that_clash(spark):
    names = ["row", "key", "may", "cut", "starts", "stops", "start", "id", "content", "__may", "n_removed"]
    docs = spark.createDataFrame([(i, "a\nb\nc", *range(len(names))) for i in (1, 2)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = D.dedup_lines(docs, removed_column="N_removed")
    assert sorted(c.lower() for c in got.columns) == sorted(c.lower() for c in docs.columns)
    assert sorted((r.doc_id, r.text, r["key"], r.may, r.starts, r.N_removed) for r in got.collect()) == [(1, "a\nb\nc", 1, 2, 4, 0), (2, "", 1, 2, 4, 3)]
