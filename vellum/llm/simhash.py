"""SimHash fingerprints of documents, and search within a Hamming radius, in DataFrame functions only.

A text's terms are its pairs of neighbouring words (lower case, parted by white space; the last word
pairs with nothing). Each occurrence votes with the pair's length, at most ``MOST_WEIGHT``, on the 64
bits of the pair's hash: longer pairs are rarer and say more. A bit is set if over half of all weight
votes for it. Votes of two bits are summed in the two halves of one long, and combined before the
shuffle; a text of 100 million words keeps within them.

The search deals 64 bits into ``blocks`` blocks. Fingerprints that differ in at most ``radius`` bits
agree in at least ``blocks - radius`` of them, so there is a table for each choice of that many blocks,
keyed by the bits in the chosen blocks (the permuted tables of a sorted index; the join is by equality
here). A pair is given by the first table in which it agrees. Equal fingerprints are one row with a count.

Null texts are empty; the fingerprint of a text without words is 0. Every row is fingerprinted, rows
that repeat as often as they occur. The next document of a row is by id, of rows that share one by a hash of
their text. Ids are of any type that has an order; only those that are whole numbers can ask. A row without
an id has an empty next text. An empty table gives no rows, other columns are not read. A very long text is
split into words in one row, as an array; its votes are summed like those of others.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.store import stored

MOST_WEIGHT = 16
#: Rows of a bucket of neighbouring ids, on average; buckets at most; rows that are drawn for each bound.
BUCKET_ROWS, BUCKETS, OVERSAMPLED = 256, 1 << 14, 8

_PAIR = 0x0000000100000001
_HALF = 0xFFFFFFFF


def words(text: Column) -> Column:
    """The words of a text in lower case."""
    return F.filter(F.split(F.lower(text), "[ \\t-\\r]+"), lambda w: w != "")


def bucket_bounds(docs: DataFrame) -> list[tuple]:
    """(id, hash) of the first row of each bucket of (id, text) ``docs`` in the order of ids and texts' hashes.

    The first is the first row of all; the others are every ``OVERSAMPLED``-th of a set of rows chosen by a hash, so that
    buckets have about ``BUCKET_ROWS`` rows whatever the ids are. What reaches the driver is bounded by ``BUCKETS``.
    """
    ids = docs.where("id is not null")
    rows, low = ids.agg(F.count("*"), F.min("id")).first()
    if not rows:
        return []
    least = ids.where(F.col("id") == F.lit(low)).agg(F.min(F.xxhash64("text"))).first()[0]
    buckets = min(BUCKETS, rows // BUCKET_ROWS)
    drawn = F.pmod(F.xxhash64("id", "hash", F.lit("bounds")), F.lit(rows)) < buckets * OVERSAMPLED
    chosen = ids.select("id", F.xxhash64("text").alias("hash")).where(drawn).distinct().collect() if buckets > 1 else []
    return [(low, least), *sorted(tuple(r) for r in chosen if tuple(r) != (low, least))[OVERSAMPLED - 1 :: OVERSAMPLED]]


def with_next(docs: DataFrame) -> DataFrame:
    """(id, text) ``docs`` with ``next_id`` and ``next_text`` of the next row by id and text's hash, the first after the last; and (bucket, alone, place), a key of rows.

    Rows fall into buckets by ``bucket_bounds``, found by binary search. The first row of each bucket also
    goes, as a copy, to the bucket before it; so one shuffle brings a row and the next together.
    """
    kind = docs.schema["id"].dataType.simpleString()
    bounds = bucket_bounds(docs)
    table = F.from_json(F.lit(json.dumps([{"id": i, "hash": h} for i, h in bounds], default=str)), f"array<struct<id:{kind},hash:bigint>>")
    own_key = F.struct(F.col("id"), F.col("hash"))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(bounds).bit_length())))])
    bucket = F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step < len(bounds)) & (own_key >= F.get(table, low + step)), low + step).otherwise(low))
    placed = docs.withColumn("hash", F.xxhash64("text")).withColumn("bucket", F.when(F.col("id").isNotNull(), bucket))
    own = F.struct(F.col("bucket"), F.lit(False).alias("copy"))
    other = F.struct(F.pmod(F.col("bucket") - 1, F.lit(max(1, len(bounds)))).alias("bucket"), F.lit(True).alias("copy"))
    is_first = F.coalesce(own_key == F.get(table, F.col("bucket")), F.lit(False))
    dealt = placed.select("id", "text", "hash", F.explode(F.when(is_first, F.array(own, other)).otherwise(F.array(own))).alias("to"))
    # rows without an id are spread by their text
    dealt = dealt.select("id", "text", "hash", "to.bucket", "to.copy", F.when(F.col("id").isNull(), F.pmod("hash", F.lit(1 << 20))).alias("alone"))
    by = W.partitionBy("bucket", "alone").orderBy("copy", "id", "hash")
    named = F.col("id").isNotNull()
    found = dealt.select("id", "text", "copy", "bucket", "alone", F.row_number().over(by).alias("place"), F.lead("id").over(by).alias("next_id"), F.when(named, F.lead("text").over(by)).alias("next_text"))
    return found.where("not copy")


def fingerprints(texts: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """The ``keys`` of the rows of ``texts``, distinct, and ``bits``, the fingerprint of ``column`` as a long."""
    own = words(F.coalesce(F.col(column), F.lit("")))
    pairs = texts.select(*keys, own.alias("words"))
    following = F.concat(F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), F.array(F.lit("")))
    pairs = pairs.select(*keys, F.explode_outer(F.arrays_zip(F.col("words").alias("a"), following.alias("b"))).alias("pair"))
    weight = F.least(F.length("pair.a") + F.length("pair.b"), F.lit(MOST_WEIGHT)).cast("long")
    votes = pairs.select(*keys, F.xxhash64("pair.a", "pair.b").alias("hash"), F.when(F.col("pair.a").isNotNull() & (F.col("pair.a") != ""), weight).otherwise(0).alias("weight"))
    sums = [F.sum(F.shiftrightunsigned("hash", i).bitwiseAND(F.lit(_PAIR)) * F.col("weight")).alias(f"v{i}") for i in range(32)]
    summed = votes.groupBy(*keys).agg(F.sum("weight").alias("total"), *sums)
    bits = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"v{i}").bitwiseAND(F.lit(_HALF)), F.shiftrightunsigned(f"v{i}", 32)
        bits = bits.bitwiseOR(F.when(low * 2 > F.col("total"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        bits = bits.bitwiseOR(F.when(high * 2 > F.col("total"), F.expr(f"shiftleft(1L, {i + 32})")).otherwise(F.lit(0).cast("long")))
    return summed.select(*keys, bits.alias("bits"))


def distance(a: Column | str, b: Column | str) -> Column:
    """Number of bits in which two fingerprints differ."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)) if isinstance(a, str) else a.bitwiseXOR(b))


def likeness(a: str, b: str) -> Column:
    """Share of bits in which two fingerprints agree."""
    return 1 - distance(a, b) / 64.0


def as_text(bits: str) -> Column:
    """A fingerprint as 16 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def masks(radius: int, blocks: int) -> list[int]:
    """For each table the bits of the blocks that its key is made of, as a signed long."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(query, bits, rows, distance): for each fingerprint in ``queries``, all those of ``prints`` within ``radius`` bits, and how many rows have each.

    Both tables have a column ``bits``; null fingerprints are left out.
    """
    if not 0 <= radius < blocks <= 64:
        raise ValueError("there must be more blocks than bits that may differ")
    table = masks(radius, blocks)
    keyed = F.explode(F.array(*[F.struct(F.lit(i).alias("table"), F.col("bits").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(table)])).alias("to")
    left = queries.select("bits").where("bits is not null").distinct().select(F.col("bits").alias("query"), keyed).select("query", "to.*")
    right = prints.where("bits is not null").groupBy("bits").agg(F.count("*").alias("rows")).select("bits", "rows", keyed).select("bits", "rows", "to.*")
    differ = F.col("query").bitwiseXOR(F.col("bits"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(table)])
    left, right = left.alias("l"), right.alias("r")
    same = (F.col("l.table") == F.col("r.table")) & (F.col("l.key") == F.col("r.key")) & (F.bit_count(differ) <= radius) & (first == F.col("l.table"))
    # neither side has a bound
    return left.join(right.hint("merge"), same).select("query", "bits", "rows", distance("query", "bits").alias("distance"))


def edited(docs: DataFrame, radius: int = 3, query_step: int = 20) -> DataFrame:
    """Fingerprints of (doc_id, text) ``docs`` and of their edited texts, and how alike they are.

    In an edited text the last quarter of the characters is replaced by as many of the next document's
    first ones. ``n_within``: for rows whose id is divisible by ``query_step``, the number of rows,
    itself included, whose fingerprint is within ``radius`` bits.
    """
    rows = with_next(docs.select(docs["doc_id"].alias("id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")))
    n = F.char_length("text").cast("long")
    quarter = F.expr("cast(char_length(text) div 4 as int)")
    rows = rows.select("bucket", "alone", "place", "id", n.alias("n_chars"), "text", "next_id", F.coalesce("next_text", F.lit("")).alias("next_text"), quarter.alias("quarter"))
    change = F.concat(F.expr("substring(text, 1, cast(n_chars as int) - quarter)"), F.expr("substring(next_text, 1, quarter)"))
    rows = rows.withColumn("edited", change)
    keys = ["bucket", "alone", "place", "id", "n_chars", "text_hash", "next_id", "next_hash", "edited_sha256", "is_edited"]
    both = F.array(F.struct(F.lit(False).alias("is_edited"), F.col("text").alias("own")), F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("own")))
    rows = rows.select("bucket", "alone", "place", "id", "n_chars", F.xxhash64("text").alias("text_hash"), "next_id", F.xxhash64("next_text").alias("next_hash"), F.unhex(F.sha2("edited", 256)).alias("edited_sha256"), F.explode(both).alias("to"))
    prints = fingerprints(rows.select(*keys[:-1], "to.is_edited", F.col("to.own").alias("own")), keys, "own")
    pick = lambda kind: F.max(F.when(F.col("is_edited") == kind, F.col("bits")))
    prints = stored(prints.groupBy(*keys[:-1]).agg(pick(False).alias("bits"), pick(True).alias("edited_bits")), "fingerprints")
    following = prints.where("id is not null").select(F.col("id").alias("next_id"), F.col("text_hash").alias("next_hash"), F.col("bits").alias("next_bits")).distinct()
    found = prints.join(following.hint("merge"), ["next_id", "next_hash"], "left").withColumn("next_bits", F.coalesce("next_bits", F.lit(0).cast("long")))
    asked = prints.where(F.expr(f"try_cast(id as decimal(38, 0)) % {query_step} = 0")).select("bucket", "place", F.col("bits").alias("query"))
    counts = within_radius(asked.select(F.col("query").alias("bits")), prints, radius).groupBy("query").agg(F.sum("rows").alias("n_within"))
    counts = stored(counts, "counts")  # so that a fingerprint that very many rows have is split by the join
    found = found.join(asked.join(counts.hint("merge"), "query").drop("query").hint("merge"), ["bucket", "place"], "left")
    return found.select(F.col("id").alias("doc_id"), "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), as_text("bits").alias("fingerprint"), as_text("edited_bits").alias("edited_fingerprint"), likeness("bits", "edited_bits").alias("near_edited"), likeness("bits", "next_bits").alias("near_next"), "n_within")
