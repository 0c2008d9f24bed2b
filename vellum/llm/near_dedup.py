"""Near-duplicate documents by b-bit MinHash.

1. Each text's set of distinct 5-word shingles gives 128 minima; four at a time they are the keys of
   32 bands, and their low two bits, packed into longs, the signature.
2. Equal sets are one class, for which its member of the smallest id stands, by a number of its own.
3. Documents that share a band are candidates. A candidate pair's similarity is estimated from the
   packed bits: equal low bits are counted with bit operations, and the share that is equal by chance
   is taken off. Pairs whose estimate is within ``MARGIN`` of the threshold are confirmed on the full
   sets: texts of pairs travel to the tasks of their first member, in salted groups of bounded size,
   and are read there as a stream.
4. A band's members are first held against its smallest id only. Of what is then still in different
   components of the same band, the members outside the band's largest component are held against all
   others: in bands of up to ``SMALL_BAND`` members as pairs, in larger ones in blocks, each a few such
   members and a stream of others. Blocks of packed signatures come first and give the members that have
   a likely partner at all; blocks of these members' texts give the links. No partner is left out.
5. Links between classes give components by label propagation.

A pair of similarity 0.75 shares no band with probability (1 - 0.75**4)**32 = 5e-6, and its estimate
is off by ``MARGIN`` (over 5 standard deviations) less often than 1e-6. Shingles are compared by
64-bit hashes, equal sets by two sums of their members' hashes, 128 bits in all. Null and empty texts and texts without words have no shingles and are linked with
nothing. Rows that share an id are documents of their own, each with the text that it has: a component's id is the smallest of its
members', and of rows that share that id all are kept. A row without an id is dropped if it is
a copy of one with an id, and kept otherwise. Very long texts are slices of their own, and count like others.
Columns beside id and text are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.arrowtext import distinct_shingles, mixed, task_memory
from vellum.llm.components import components
from vellum.llm.filters import filter_of, member, without
from vellum.llm.store import removed, stored, unused

BANDS, ROWS, BITS = 32, 4, 2
HASHES = BANDS * ROWS
#: Links have at least this share of shingles in common, in hundredths.
THRESHOLD = 75
#: How far below the threshold an estimate may be for the pair to be confirmed on its full sets.
MARGIN = 0.25
#: Members that are held against one text in one group.
GROUP = 96
#: Members of a band whose pairs are listed at most; and of larger ones, members outside the largest component, and others, of a block: of texts, and of signatures.
SMALL_BAND, BLOCK_OUTSIDE, BLOCK_OTHERS = 32, 64, 2048
SIGNED_OUTSIDE, SIGNED_OTHERS = 512, 1024

_random = np.random.default_rng(10)
_FACTORS = (_random.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1))[None, :]
_OFFSETS = _random.integers(0, 2**32, HASHES, dtype=np.uint32)[None, :]
_BAND_FACTORS = _random.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each of ``HASHES`` hash functions over a set that is not empty."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)[:, None]
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 4096):
        part = low[at : at + 4096] * _FACTORS + _OFFSETS
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(least, part.min(axis=0), out=least)
    return least


def signatures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, hash, n, set_a, set_b, bands, bits): hash of each text, size and key of its shingle set, its bands and packed low bits."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memory():
            for batch in source:
                sizes, keys, bands, bits = [], [], [], []
                for own in distinct_shingles(batch.column(1)):
                    sizes.append(len(own))
                    if not len(own):
                        keys.append((0, 0))
                        bands.append(None)
                        bits.append(None)
                        continue
                    least = minima(own)
                    keys.append((int(mixed(own).sum().view(np.int64)), int(mixed(own ^ np.uint64(0x5DEECE66D)).sum().view(np.int64))))
                    bands.append(mixed((least.reshape(BANDS, ROWS).astype(np.uint64) * _BAND_FACTORS).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64))
                    low = (least & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
                    bits.append((low << np.arange(0, 64, BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64))
                a, b = zip(*keys) if keys else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                    ["id", "hash", "n", "set_a", "set_b", "bands", "bits"],
                )

    columns = _hashed(docs, id_column, text_column)
    kind = columns.schema["id"].dataType.simpleString()
    return columns.mapInArrow(batches, f"id {kind}, hash long, n long, set_a long, set_b long, bands array<long>, bits array<long>")


def _hashed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = docs[text_column].cast("string")
    return docs.select(docs[id_column].alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))


def estimate(bits_a: Column, bits_b: Column) -> Column:
    """Similarity that two packed signatures give, corrected for low bits that are equal by chance."""
    differ = F.lit(0)
    for i in range(HASHES * BITS // 64):
        other = bits_a[i].bitwiseXOR(bits_b[i])
        differ = differ + F.bit_count(other.bitwiseOR(F.shiftrightunsigned(other, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    by_chance = 2.0**-BITS
    return ((1 - differ / HASHES) - by_chance) / (1 - by_chance)


def likely(n_a: Column, n_b: Column, bits_a: Column, bits_b: Column) -> Column:
    """Whether sizes and packed bits let two sets be as similar as the threshold asks."""
    sizes = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * THRESHOLD
    return sizes & (estimate(bits_a, bits_b) >= THRESHOLD / 100 - MARGIN)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) of (a, b, a_key, b_key) ``pairs`` whose full shingle sets are as similar as the threshold asks.

    ``texts`` has (key, text). A text reaches the pairs it is in, once for each group of its partners.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    dealt = stored(pairs.join(counts, "a").select("a", "b", "a_key", "b_key", F.pmod(F.xxhash64("b"), "groups").alias("salt")), "pairs")
    firsts = dealt.select("a", "salt", "a_key").distinct().join(texts, F.col("a_key") == texts.key).select("a", "salt", F.lit(None).cast(dealt.schema["b"].dataType).alias("b"), "text")
    seconds = dealt.join(texts, F.col("b_key") == texts.key).select("a", "salt", "b", "text")
    rows = firsts.unionByName(seconds).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, np.zeros(0, np.uint64)
        with task_memory():
            for batch in source:
                kept = []
                heads, salts, partners = (batch.column(i).to_pylist() for i in range(3))
                for i, own in enumerate(distinct_shingles(batch.column(3))):
                    if partners[i] is None:
                        key, first = (heads[i], salts[i]), own
                        continue
                    assert key == (heads[i], salts[i])
                    both = len(np.intersect1d(first, own, assume_unique=True))
                    if both and 100 * both >= THRESHOLD * (len(first) + len(own) - both):
                        kept.append(i)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), batch.column(2).take(pa.array(kept, pa.int64()))], ["a", "b"])

    kind = dealt.schema["a"].dataType.simpleString()
    return rows.mapInArrow(batches, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: its id, ``n_shingles``, ``component_id`` (the smallest id it is linked to) and ``kept``."""
    found = _found(docs, id_column, text_column)
    return found.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def _found(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, hash, n, component, kept) of all rows; ``hash`` is that of the text."""
    signed = stored(signatures(docs, id_column, text_column), "signatures")
    # classes of equal sets
    key = F.when(F.col("id").isNotNull(), F.struct("id", "hash"))
    classes = signed.where("n > 0").groupBy("set_a", "set_b", "n").agg(F.min(key).alias("rep"), F.count("*").alias("members"))
    copies = stored(classes.where("members > 1 and rep is not null").select("set_a", "set_b", "n", "rep"), "classes")
    members = signed.join(copies, ["set_a", "set_b", "n"], "left").select("n", key.alias("key"), F.coalesce("rep", key).alias("rep"), "bands", "bits")
    reps = members.where("n > 0 and key = rep").select("key", "n", "bits", "bands").dropDuplicates(["key"])
    # from here on an id is the number of a class
    reps = stored(reps.select(F.monotonically_increasing_id().alias("id"), "key", "n", "bits", "bands"), "reps")
    banded = reps.select("id", F.col("key.id").alias("named"), F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min_by("id", "named").alias("head"), F.count("*").alias("members")).where("members > 1")
    heads = stored(heads.select("band", "head"), "heads")
    # first each band's members against its smallest id
    in_bands = stored(banded.join(heads, "band").select("band", "head", "id"), "bands")
    pairs = in_bands.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    first, second = (reps.select(F.col("id").alias(x), F.col("key").alias(f"{x}_key"), "n", "bits") for x in "ab")
    pairs = pairs.join(first, "a").select("a", "b", "a_key", F.col("n").alias("n_a"), F.col("bits").alias("bits_a")).join(second, "b")
    pairs = pairs.where(likely(F.col("n_a"), F.col("n"), F.col("bits_a"), F.col("bits")))
    pairs = stored(pairs.select("a", "b", "a_key", "b_key"), "candidates")
    ids = _hashed(docs, id_column, text_column).where("id is not null").select(F.struct("id", "hash").alias("key"), "text")
    links = stored(confirmed(pairs, _texts_of(pairs, ids)), "links")
    labels = components(links)
    # then what is in one band but not yet in one component
    labelled = stored(in_bands.join(labels, in_bands.id == labels.node, "left").select("band", "head", "id", F.coalesce("label", "id").alias("label")), "labelled")
    groups = labelled.groupBy("band", "label").agg(F.count("*").alias("size"))
    open_bands = groups.groupBy("band").agg(F.count("*").alias("labels"), F.sum("size").alias("size"), F.max("size").alias("inside"), F.max_by("label", F.struct("size", "label")).alias("main"))
    open_bands = stored(open_bands.where("labels > 1").select("band", "main", "size", (F.col("size") - F.col("inside")).alias("outside")), "open")
    rows = labelled.join(open_bands, "band").where("id <> head").select("band", "id", "label", "size", "outside", (F.col("label") == F.col("main")).alias("inside"))
    rows = stored(rows.join(reps.select("id", "key", "n", "bits", "bands"), "id"), "rest")
    a, b = (rows.where(F.col("size") <= SMALL_BAND).select("band", "id", "key", "label", "inside", "n", "bits").alias(x) for x in "xy")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    alike = ~y("inside") & (x("label") != y("label")) & (x("inside") | (x("id") < y("id"))) & likely(x("n"), y("n"), x("bits"), y("bits"))
    more = stored(a.join(b, (x("band") == y("band")) & alike).select(x("id").alias("a"), y("id").alias("b"), x("key").alias("a_key"), y("key").alias("b_key")).distinct(), "candidates")
    large = with_likely_partners(rows.where(F.col("size") > SMALL_BAND))
    further = stored(confirmed(more, _texts_of(more, ids)).union(confirmed_in_blocks(large, ids)), "links")
    if not further.isEmpty():
        labels = components(links.union(further))
    # a component has the smallest id of its classes' first members
    linked = stored(reps.select("id", "key").join(labels, F.col("id") == labels.node).select("key", "label"), "linked")
    named = linked.groupBy("label").agg(F.min("key.id").alias("component"))
    linked = stored(linked.join(named, "label").select("key", "component"), "components")
    found = signed.join(copies, ["set_a", "set_b", "n"], "left").select("id", "hash", "n", F.coalesce("rep", key).alias("rep"))
    found = found.join(linked, found.rep == linked.key, "left")
    component = F.coalesce("component", "rep.id")
    removed(docs.sparkSession, in_bands, labelled, rows, heads, open_bands, reps, pairs, more)
    return found.select("id", "hash", "n", component.alias("component"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def _texts_of(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(key, text) of the documents in ``pairs``, and of few others: what is not in a filter of keys stays where it is. Rows that share id and text are one."""
    named = pairs.select(F.col("a_key").alias("key")).union(pairs.select("b_key")) if "a_key" in pairs.columns else pairs.select("key")
    held = filter_of(named.select(F.xxhash64("key").alias("key")).distinct(), "key")
    return ids.where(member(ids, held, F.xxhash64("key"))).groupBy("key").agg(F.first("text").alias("text"))


def in_blocks(rows: DataFrame, columns: list[str], outside_of: int, others_of: int) -> DataFrame:
    """(band, block, part, role, ..) of ``rows``, block by block: first members outside the band's largest component (role 0), then a stream of members (role 1).

    Both are split by hash into as many parts as keep a block's size; every member outside meets every member in one block.
    """
    outside, others = F.ceil(F.col("outside") / outside_of), F.ceil(F.col("size") / others_of)
    dealt = rows.select("band", *columns, "inside", outside.alias("outs"), others.alias("others"))
    own = lambda parts, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(parts))
    all_of = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    held = dealt.where("not inside").select("band", own("outs", 1).alias("block"), all_of("others").alias("part"), F.lit(0).alias("role"), *columns)
    stream = dealt.select("band", all_of("outs").alias("block"), own("others", 2).alias("part"), F.lit(1).alias("role"), *columns)
    return held.unionByName(stream).repartition("band", "block", "part").sortWithinPartitions("band", "block", "part", "role")


def likely_beside(held: list[np.ndarray], label: object, n: int, bits: np.ndarray) -> np.ndarray:
    """Which of the held (labels, sizes, bits) are of another component and by sizes and packed bits may be as similar as the threshold asks."""
    labels, sizes, signed = held
    differ = signed ^ bits.view(np.uint64)
    differ = np.bitwise_count((differ | (differ >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1)
    share = ((1 - differ / HASHES) - 2.0**-BITS) / (1 - 2.0**-BITS)
    return (labels != label) & (share >= THRESHOLD / 100 - MARGIN) & (np.minimum(sizes, n) * 100 >= np.maximum(sizes, n) * THRESHOLD)


def with_likely_partners(rows: DataFrame) -> DataFrame:
    """The ``rows`` of large bands' members that have a likely partner in another component of the band, with the band's new ``size`` and ``outside``.

    Only signatures are compared, and of a block no more comes out than its members.
    """
    both = in_blocks(rows, ["id", "label", "n", "bits"], SIGNED_OUTSIDE, SIGNED_OTHERS)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, waiting, held, hit = None, [], [], None, None

        def hits() -> list[tuple]:
            return [] if hit is None else [(key[0], ids[j]) for j in np.flatnonzero(hit)]

        def out(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], kind)], ["band", "id"])

        kind = None
        for batch in source:
            found, kind = [], batch.column(4).type
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            roles, names, labels, sizes = (batch.column(i).to_pylist() for i in (3, 4, 5, 6))
            bits = np.stack(batch.column(7).to_numpy(zero_copy_only=False)) if batch.num_rows else None
            for i, role in enumerate(roles):
                if keys[i] != key:
                    found += hits()
                    key, ids, waiting, held, hit = keys[i], [], [], None, None
                if role == 0:
                    ids.append(names[i])
                    waiting.append((labels[i], sizes[i], bits[i].view(np.uint64)))
                elif waiting:
                    if held is None:
                        held = [np.array([w[0] for w in waiting], object), np.array([w[1] for w in waiting]), np.stack([w[2] for w in waiting])]
                        hit = np.zeros(len(ids), bool)
                    some = likely_beside(held, labels[i], sizes[i], bits[i])
                    if some.any():
                        hit |= some
                        found.append((key[0], names[i]))
            yield out(found, kind)
        if kind is not None:
            yield out(hits(), kind)

    kind = rows.schema["id"].dataType.simpleString()
    likely_ones = both.mapInArrow(batches, f"band long, id {kind}").distinct()
    left = stored(rows.join(likely_ones.hint("merge"), ["band", "id"], "left_semi").drop("size", "outside"), "likely")
    sizes = left.groupBy("band").agg(F.count("*").alias("size"), F.count_if(~F.col("inside")).alias("outside"))
    return left.join(sizes, "band")


def confirmed_in_blocks(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Links (a, b) between the members of ``rows``' bands that are outside the band's largest component and all members of other components.

    A pair that shares several bands is looked at in the first of them.
    """
    dealt = rows.join(_texts_of(rows, ids), "key")
    both = in_blocks(dealt, ["id", "label", "bits", "bands", "text"], BLOCK_OUTSIDE, BLOCK_OTHERS)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tables = None, [], None
        with task_memory():
            for batch in source:
                first, second = [], []
                keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
                roles, names, labels = (batch.column(i).to_pylist() for i in (3, 4, 5))
                bits, bands = (np.stack(batch.column(i).to_numpy(zero_copy_only=False)) if batch.num_rows else None for i in (6, 7))
                for i, own in enumerate(distinct_shingles(batch.column(8))):
                    if keys[i] != key:
                        key, held, tables = keys[i], [], None
                    if roles[i] == 0:
                        held.append((names[i], labels[i], len(own), bits[i].view(np.uint64), bands[i], own))
                        continue
                    if not held:
                        continue
                    if tables is None:
                        tables = [np.array([h[k] for h in held], object if k < 2 else None) for k in range(5)]
                    n, common = tables[2], tables[4] == bands[i]
                    here = tables[4][np.arange(len(held)), common.argmax(axis=1)] == key[0]
                    for j in np.flatnonzero(here & likely_beside(tables[1:4], labels[i], len(own), bits[i])):
                        both = len(np.intersect1d(held[j][5], own, assume_unique=True))
                        if 100 * both >= THRESHOLD * (n[j] + len(own) - both):
                            first.append(min(names[i], held[j][0]))
                            second.append(max(names[i], held[j][0]))
                yield pa.RecordBatch.from_arrays([pa.array(x, batch.column(4).type) for x in (first, second)], ["a", "b"])

    kind = dealt.schema["id"].dataType.simpleString()
    return both.mapInArrow(batches, f"a {kind}, b {kind}").distinct()


def without_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one of smallest id. All columns stay. Rows are dropped by id and text, never by id alone."""
    own = unused(docs.columns, "key")
    dropped = _found(docs, id_column, text_column).where("not kept").select(F.struct("id", "hash").alias(own)).distinct()
    text = docs[text_column].cast("string")
    keyed = docs.withColumn(own, F.struct(docs[id_column].alias("id"), F.xxhash64(text).alias("hash")))
    return without(keyed, stored(dropped, "dropped"), own).select(*[F.col(f"`{c}`") for c in docs.columns])
