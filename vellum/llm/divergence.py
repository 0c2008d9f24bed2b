"""How far the sources of a language are apart in their words, by inclusion and exclusion over supports.

Terms are runs of letters and of characters beyond ASCII, A-Z in lower case. A language keeps the terms that at least
``LEAST_DOCS`` of its documents have, V of them. A (lang, source) group gives a kept term of which it has c occurrences, of N in
all, the price p = 1 + floor(10**9 * (c + 2) / (N + 2V)), and two prices differ by floor((p - q)**2 / (p + q)). The sum
over all V terms for two groups is made without a table of all terms by all groups:

1. One-sided: a group's histogram of counts, which is far smaller than its terms, priced against the other group's price of a
   count of zero, as if no term were in both.
2. Overlap: where postings of both groups have the term, a join on (lang, term) puts the right difference in place of the two of step 1.
3. Terms that are in neither differ by one constant, times their number.

Occurrences are counted per Arrow batch in the tasks, with the terms themselves as keys, and combined before the shuffle.
Joined postings are summed in the task that joins them. All sums are of whole numbers. Counts of a term may reach 10**19.

Null texts, languages and sources are empty strings, and these are a language and a source like others. A group without
terms is there with counts of zero; a language without kept terms gives pairs of value 0. Rows that repeat count as often as they
occur. Very long texts are a batch of their own. Other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.arrowtext import task_memory, text_slices
from vellum.llm.store import removed, stored

#: Documents of its language that a kept term is in at least; terms that a group shows at most.
LEAST_DOCS, TOP_TERMS = 10, 10
#: Parts that the groups of one language are dealt into when they meet all others.
SALTS = 32
#: Bytes of text that are counted at once.
COUNTED = 1 << 21

#: Bytes of a term as they count, all others as a space.
_TERMS = np.full(256, 0x20, np.uint8)
_TERMS[0x80:] = np.arange(0x80, 0x100)
_TERMS[0x61:0x7B] = np.arange(0x61, 0x7B)
_TERMS[0x41:0x5B] = np.arange(0x61, 0x7B)


def occurrences(groups: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of a slice's texts, whose groups have numbers: group, term, occurrences and texts with it, each group and term once."""
    plain = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_TERMS[data])])
    lists = pc.ascii_split_whitespace(plain)
    text, terms = pc.list_parent_indices(lists), pc.list_flatten(lists)
    real = pc.not_equal(pc.binary_length(terms), 0)
    text, coded = text.filter(real).to_numpy(), terms.filter(real).dictionary_encode()
    code, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    if not size:
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, times = np.unique(groups[text] * size + code, return_counts=True)
    in_text = np.unique(text * size + code)
    _, docs = np.unique(groups[in_text // size] * size + in_text % size, return_counts=True)
    return keys // size, coded.dictionary.take(pa.array(keys % size)).cast(pa.string()), times.astype(np.int64), docs.astype(np.int64)


def counted(docs: DataFrame, text_column: str, lang_column: str, source_column: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term of each group; and of each group a row without a term."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memory():
            for batch in source:
                langs, sources = (batch.column(i).dictionary_encode() for i in (0, 1))
                groups = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()

                def rows(found: tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]) -> pa.RecordBatch:
                    own, terms, times, texts = found
                    lang, part = np.divmod(own, max(1, len(sources.dictionary)))
                    columns = [langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(part)), terms, pa.array(times), pa.array(texts)]
                    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

                own = np.unique(groups)
                none = np.zeros(len(own), np.int64)
                yield rows((own, pa.nulls(len(own), pa.string()), none, none))
                for row, end, data, offsets in text_slices(batch.column(2), COUNTED):
                    yield rows(occurrences(groups[row:end], data, offsets))

    name = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    columns = docs.select(name(lang_column).alias("lang"), name(source_column).alias("source"), docs[text_column].cast("string").alias("text"))
    found = columns.mapInArrow(batches, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(count: str, total: str, kept: str) -> Column:
    """The price of a term of ``count`` occurrences where all have ``total`` and there are ``kept`` terms; null if there are none."""
    above, below = f"cast(1000000000 as decimal(10,0)) * (cast({count} as decimal(20,0)) + 2)", f"cast({total} as decimal(20,0)) + 2 * {kept}"
    return F.expr(f"if({kept} > 0, 1 + ({above}) div ({below}), null)")


def difference(p: str, q: str) -> Column:
    """How far two prices are apart."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def priced_postings(docs: DataFrame, text_column: str, lang_column: str, source_column: str, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """Kept terms of each group, (lang, source, term, n, p, zero, q), and all groups, (lang, source, support, kept, zero); both stored.

    ``p`` is the group's price, ``zero`` that of a term that the group has not, ``q`` the language's price.
    """
    rows = stored(counted(docs, text_column, lang_column, source_column), "terms")
    terms = rows.where("term is not null")
    kept = stored(terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs).drop("docs"), "kept")
    own = stored(terms.drop("docs").join(kept, ["lang", "term"]), "postings")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    sizes = own.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    groups = rows.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = stored(groups.withColumn("zero", price("0", "total", "kept")), "groups")
    priced = own.join(groups, ["lang", "source"])
    priced = priced.select("lang", "source", "term", "n", price("n", "total", "kept").alias("p"), "zero", price("lang_n", "lang_total", "kept").alias("q"))
    priced = stored(priced, "priced")
    removed(docs.sparkSession, rows, kept, own)
    return priced, groups.select("lang", "source", "support", "kept", "zero")


def pair_values(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the sum of differences over all kept terms for any two groups of a language, both ways."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("support").alias("item_support"), F.col("zero").alias("item_zero"))
    other = other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = lambda *by: F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")
    met = groups.withColumn("salt", dealt("source")).join(other, ["lang", "salt"]).where("source <> item")
    neither = F.coalesce((F.col("kept") - F.col("support") - F.col("item_support")) * difference("zero", "item_zero"), F.lit(0).cast("long"))
    neither = met.select("lang", "source", "item", neither.alias("value"))
    counts = postings.groupBy("lang", "source", "n").agg(F.first("p").alias("p"), F.count("*").alias("terms"))
    one_sided = counts.withColumn("salt", dealt("source", "n")).join(other, ["lang", "salt"]).where("source <> item")
    one_sided = one_sided.groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * difference("p", "item_zero")).alias("value"))
    a = postings.select("lang", "term", "source", "p", "zero")
    b = postings.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("item_p"), F.col("zero").alias("item_zero"))
    right = difference("p", "item_p") - difference("p", "item_zero") - difference("zero", "item_p") + difference("zero", "item_zero")
    both = a.join(b.hint("merge"), ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(right).alias("value"))
    two_ways = stored(one_sided.union(both), "pairs")
    back = two_ways.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    return neither.union(two_ways).union(back).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_values(postings: DataFrame, most: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): the ``most`` terms that a group has more of than its language, by how much they differ."""
    over = postings.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), difference("p", "q").alias("value"))
    return over.withColumn("rank", _rank()).where(F.col("rank") <= most)


def _rank() -> Column:
    return F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))


def audit(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source", least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has all other sources of the language, part ``term`` the most peculiar terms."""
    postings, groups = priced_postings(docs, text_column, lang_column, source_column, least_docs)
    pairs = pair_values(postings, groups).withColumn("rank", _rank())
    shown = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shown(pairs, "pair").union(shown(term_values(postings, top_terms), "term"))
