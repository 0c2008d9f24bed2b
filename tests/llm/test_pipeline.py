import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from test_decontaminate import brute as leaks
from test_line_dedup import brute as lines
from test_near_dedup import brute as groups

import __spark_entry__
from vellum.llm import bpe, language_id

FOLDER = "/root/testdata/sf0.001"


def test_stages_as_by_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame([(10**6 + i, t, None, None, len(t or "")) for i, t in enumerate([None, "", "?? 12", "of the"])], docs.schema)
    docs = docs.union(extra)
    columns = docs.columns
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = language_id.fit(docs)
    rejected = {r.doc_id for r in language_id.identify(docs, model).collect() if r.rejected}
    assert {10**6, 10**6 + 1, 10**6 + 2} <= rejected and len(rejected) < 10

    stage = dict(corpus_pipeline.STAGES)
    docs = stage["language ID"](spark, docs, FOLDER)
    assert docs.columns == columns
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert kept == {i: r.text for i, r in rows.items() if i not in rejected}

    docs = stage["line dedup"](spark, docs, FOLDER)
    assert docs.columns == columns
    kept = {i: t for i, t in lines(list(kept.items())).items() if t.strip()}
    assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {i: (t, len(t)) for i, t in kept.items()}

    docs = stage["near dedup"](spark, docs, FOLDER)
    assert docs.columns == columns
    one = {i for i, _, _, first in groups(list(kept.items())) if first}
    assert {r.doc_id for r in docs.collect()} == one

    docs = stage["decontamination"](spark, docs, FOLDER)
    assert docs.columns == columns
    clean = one - {d for d, *_ in leaks([(i, kept[i]) for i in one], [tuple(r) for r in items.select("item_id", "text").collect()])}
    assert {r.doc_id for r in docs.collect()} == clean

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in stage["byte-level BPE"](spark, docs, FOLDER).collect():
        ids = library.encode_ordinary(kept[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_run_is_registered(spark):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, FOLDER).count() > 100
