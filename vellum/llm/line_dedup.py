"""Removal of repeated runs of lines by winnowing.

A text's lines that have words are hashed (white space at their ends left aside). Windows are
``RUN_LINES`` lines in a row, and shorter rows of at least ``RUN_WORDS`` words. Each window selects
its smallest line hash as its fingerprint, so two equal windows select the same line: whatever run
of that length two places share has a fingerprint in common. Fingerprints that occur at one place
only are dropped; windows behind the others are joined by position with the first place (smallest
id, then line) that has the same window. Matches on the same diagonal of two texts are extended both
ways to maximal runs, and every run that is not the first of its kind is deleted. Where a run overlaps
its own source (lines that repeat at once), the source stays whole and what is behind it is deleted.

The order of ids is the order of texts. Nothing is compared in pairs: each window meets only the
first of its kind, whose minimum is combined before the shuffle, so a line that a third of all texts
share costs one row a place. Null and empty texts, and rows without an id, stay as they are. Rows that share an id are texts of
their own, in the order of a hash of their text; rows that share the text too are one text, and are cut alike. A text whose lines are all repeated becomes empty. Very long texts are
a slice of their own. Any other columns stay as they are, whatever their names. An empty table stays empty.
Contents of windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.arrowtext import mixed, span_hashes, task_memory, text_slices, word_spans
from vellum.llm.filters import filter_of, member
from vellum.llm.store import stored, unused

#: Lines of a run that is deleted in any case, and words of one that has fewer lines.
RUN_LINES, RUN_WORDS = 3, 50

_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines with words of a slice's texts: hash, words, line number in the text; and where each text's begin."""
    starts, ends, _ = word_spans(data, offsets)
    breaks = np.flatnonzero(data == 10)
    text = np.searchsorted(offsets, starts, side="right") - 1
    line = np.searchsorted(breaks, starts)
    new = np.ones(len(starts), bool)
    new[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    hashes = span_hashes(data, starts[first], ends[last], lower=False)
    number = line[first] - np.searchsorted(breaks, offsets[text[first]])
    return hashes, last - first + 1, number, np.searchsorted(text[first], np.arange(len(offsets)))


def windows_of(data: np.ndarray, offsets: np.ndarray, run_lines: int = RUN_LINES, run_words: int = RUN_WORDS) -> dict[str, np.ndarray]:
    """The windows of a slice's texts: text, first and last line, fingerprint, content, and whether no earlier window selects the same line."""
    hashes, words, number, firsts = lines_of(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    found: dict[str, list[np.ndarray]] = {k: [] for k in ("text", "start", "stop", "fingerprint", "content", "at")}
    for size in range(1, run_lines + 1):
        n = len(hashes) - size + 1
        if n <= 0:
            break
        i = np.flatnonzero((text[:n] == text[size - 1 :]) & (np.add.reduce([words[k : n + k] for k in range(size)]) >= (run_words if size < run_lines else 0)))
        members = np.stack([hashes[i + k] for k in range(size)])
        at = size - 1 - np.argmin(members[::-1], axis=0)
        found["text"].append(text[i])
        found["start"].append(number[i])
        found["stop"].append(number[i + size - 1])
        found["fingerprint"].append(members.min(axis=0))
        found["content"].append(mixed(np.add.reduce([members[k] * _PLACES[k] for k in range(size)]) + np.uint64(size)))
        found["at"].append(i + at)
    if not found["text"]:
        return {k: np.zeros(0, np.int64) for k in (*found, "selects")}
    out = {k: np.concatenate(v) for k, v in found.items()}
    out["selects"] = np.zeros(len(out["at"]), bool)
    out["selects"][np.unique(out["at"], return_index=True)[1]] = True
    return out


def windows(docs: DataFrame, id_column: str, text_column: str, run_lines: int, run_words: int) -> DataFrame:
    """(id, hash, start, stop, fingerprint, content, selects) of the windows of all texts; ``hash`` is that of the text."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memory():
            for batch in source:
                for row, end, data, offsets in text_slices(batch.column(1)):
                    w = windows_of(data, offsets, run_lines, run_words)
                    yield pa.RecordBatch.from_arrays([
                        *(batch.column(i).slice(row, end - row).take(pa.array(w["text"], pa.int64())) for i in (0, 2)),
                        pa.array(w["start"], pa.int32()),
                        pa.array(w["stop"], pa.int32()),
                        pa.array(w["fingerprint"].astype(np.uint64).view(np.int64)),
                        pa.array(w["content"].astype(np.uint64).view(np.int64)),
                        pa.array(w["selects"].astype(bool)),
                    ], ["id", "hash", "start", "stop", "fingerprint", "content", "selects"])

    text = docs[text_column].cast("string")
    columns = docs.select(docs[id_column].alias("id"), text.alias("text"), F.xxhash64(text).alias("hash")).where("id is not null")
    kind = columns.schema["id"].dataType.simpleString()
    return columns.mapInArrow(batches, f"id {kind}, hash long, start int, stop int, fingerprint long, content long, selects boolean")


def repeated_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", run_lines: int = RUN_LINES, run_words: int = RUN_WORDS) -> DataFrame:
    """(id, start, stop, source_id, source_start, cut): maximal runs of lines that an earlier place has, that place, and the first line to delete."""
    return _runs(docs, id_column, text_column, run_lines, run_words).select("id", "start", "stop", "source_id", "source_start", "cut")


def _runs(docs: DataFrame, id_column: str, text_column: str, run_lines: int = RUN_LINES, run_words: int = RUN_WORDS) -> DataFrame:
    """The same with ``hash``, that of the text."""
    if not 1 <= run_lines <= len(_PLACES):
        raise ValueError(f"run_lines is not in 1..{len(_PLACES)}")
    found = stored(windows(docs, id_column, text_column, run_lines, run_words), "windows")
    shared = found.where("selects").groupBy("fingerprint").agg(F.count("*").alias("places")).where("places > 1").select("fingerprint")
    shared = stored(shared, "fingerprints")
    # none of these tables has a bound, so none is broadcast
    found = found.join(shared.hint("merge"), "fingerprint", "left_semi").select("id", "hash", "start", "stop", "content")
    first = found.groupBy("content").agg(F.min(F.struct("id", "hash", "start", "stop")).alias("first"), F.count("*").alias("places")).where("places > 1")
    first = stored(first.select("content", F.col("first.id").alias("source_id"), F.col("first.hash").alias("source_hash"), F.col("first.start").alias("source_start"), F.col("first.stop").alias("source_stop")), "first")
    later = found.join(first.hint("merge"), "content").where("id > source_id or hash > source_hash or start > source_start")
    # matches on one diagonal that touch or overlap are one run
    diagonal = W.partitionBy("id", "hash", "source_id", "source_hash", "diagonal").orderBy("start", "stop")
    later = later.withColumn("diagonal", F.col("start") - F.col("source_start"))
    later = later.withColumn("reached", F.max("stop").over(diagonal.rowsBetween(W.unboundedPreceding, -1)))
    later = later.withColumn("run", F.count(F.when(F.col("reached").isNull() | (F.col("start") > F.col("reached") + 1), 1)).over(diagonal))
    runs = later.groupBy("id", "hash", "source_id", "source_hash", "diagonal", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("source_start").alias("source_start"), F.max("source_stop").alias("source_stop"))
    # a source is never cut
    cut = F.when((F.col("id") == F.col("source_id")) & (F.col("hash") == F.col("source_hash")), F.greatest(F.col("start"), F.col("source_stop") + 1)).otherwise(F.col("start"))
    return runs.select("id", "hash", "start", "stop", "source_id", "source_start", cut.alias("cut")).where("cut <= stop")


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("removed", T.IntegerType())]))
def _without(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.DataFrame:
    """Texts without the lines of their runs, and the number of lines taken."""
    out, counts = [], []
    for text, start, stop in zip(texts, starts, stops):
        if text is None:
            out.append(None)
            counts.append(0)
            continue
        lines = text.split("\n")
        change = np.zeros(len(lines) + 1, np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, np.asarray(stop) + 1, -1)
        kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
        out.append("\n".join([lines[i] for i in kept]))
        counts.append(len(lines) - len(kept))
    return pd.DataFrame({"text": out, "removed": counts})


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", removed_column: str | None = None, **limits: int) -> DataFrame:
    """``docs`` with the later repeats of runs of lines deleted from the text; all columns stay.

    ``removed_column``, if named, is added, or takes the place of the column of that name: the number of lines deleted.
    """
    runs = _runs(docs, id_column, text_column, **limits)
    row, key, own, may, found = (unused([*docs.columns, "starts", "stops"], c) for c in ("row", "key", "hash", "may", "cut"))
    cuts = runs.groupBy("id", "hash").agg(F.collect_list("cut").alias("starts"), F.collect_list("stop").alias("stops"))
    cuts = stored(cuts.select(F.col("id").alias(key), F.col("hash").alias(own), "starts", "stops"), "cuts")
    # texts without a cut stay where they are
    held = filter_of(cuts.select(F.xxhash64(key, own).alias("key")), "key")
    of_text = F.xxhash64(docs[text_column].cast("string"))
    marked = docs.withColumn(may, member(docs, held, F.xxhash64(docs[id_column], of_text)))
    whole = marked.where(F.col(may)).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col(id_column).alias(key), of_text.alias(own))
    joined = whole.join(cuts.hint("merge"), [key, own], "left")
    text = F.col(row)[text_column]
    hit = F.col("starts").isNotNull() & text.isNotNull()
    joined = joined.withColumn(found, _without(F.when(hit, text), F.col("starts"), F.col("stops")))
    kept = [c for c in docs.columns if removed_column is None or c.lower() != removed_column.lower()]
    columns = [(F.when(hit, F.col(found)["text"]).otherwise(text) if c == text_column else F.col(row)[c]).alias(c) for c in kept]
    same = marked.where(~F.col(may)).select(*[F.col(f"`{c}`") for c in kept])
    if removed_column:
        columns.append(F.when(hit, F.col(found)["removed"]).otherwise(0).alias(removed_column))
        same = same.withColumn(removed_column, F.lit(0))
    return same.unionByName(joined.select(*columns))
