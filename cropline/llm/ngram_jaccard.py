"""N-gram Jaccard join: the sparse product of the document by n-gram incidence, in blocks, under size-derived bounds.

A document's set is its distinct five-word shingles (all its words as one where it has fewer). Two sets link when
100 * overlap >= ``percent`` * union. The product is not formed whole:

1. Column counts. Tasks send sorted blocks of shingle keys by column block; a block's task merges them and writes the
   keys that two or more documents have, with the logarithm of their count, as a sorted array that workers map. The number
   of blocks follows the number of words, so a key has as many bits beyond its block as keep false matches rare at any
   size; a false match only orders columns differently.
2. Equal sets become one row, known by a 128-bit hash of the set.
3. Rows keep the columns that the bound needs: two sets of which one has n shingles can only link if they share one of
   the first n - ceil(n * percent / 100) + 1 shingles of each, in any common order. The order here is by count, rarest
   first, then by hash, so common passages come last; columns that one document alone has are left out of the product,
   as they add to no overlap.
4. A first product of each column with its first row links rows to the row they share most columns with. Overlaps of
   these pairs are counted over the whole sets, and links make classes. Groups of near copies end in one class here with
   one pair per row.
5. Turns: in each column of many classes every class meets some rows of the largest one there, other ones in each turn; for each class
   the pair whose bitmaps differ least is counted over the whole sets, and links merge classes. Turns end where few link, as
   a turn passes over all crowded columns again; what is not merged then is left to the second product.
6. The second product takes only columns whose rows are in several classes, and only pairs of different classes whose
   sizes, places in the order and bitmaps (4,096 bits; two sets differ in a shingle at least for each differing bit) leave
   enough overlap possible; from the smaller set n - ceil(n * 2p / (100 + p)) + 1 columns are enough. These are counted
   over the whole sets too. A pair inside a class needs no count, as it is connected already; so no link between
   different classes is lost.

Defined cases: null texts and texts without words have empty sets and link with nothing; a null document id takes part
and gets the smallest non-null id of its component, or null; rows that share an id are judged by their texts; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropline.llm.common import (
    array_uri, block_and_key, components, keep_rows, map_array, mixed, put_array, scratch_dir, stored, text_chunks, unused_name, window_hashes,
    word_hashes,
)

SHINGLE = 5
#: Words per column block: a block's keys are merged in one task.
WORDS_PER_BLOCK = 2_000_000
#: Keys that a counting task holds before it sends them.
HELD_KEYS = 2_000_000
#: Longs of a row's bitmap.
BITMAP = 64
#: Classes of a column up to which all its pairs may be listed.
CROWD = 16
#: Rows of the largest class of a column that each other class meets in a turn.
TRIES = 4
#: Turns of class partners end where fewer than one in ENOUGH of them links, or fewer than FEW and than one for each SHARE crowded rows.
ENOUGH, FEW, SHARE = 3, 32, 100
#: Columns before an entry that are looked at to find a pair once, not at every column that it shares.
BEFORE = 8

SET_SCHEMA = ("doc_id long, text_key long, n_shingles long, s1 long, s2 long, "
              "bits array<long>, columns array<struct<col: long, at: int>>")


def by_owner(hashes: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """The order by (owner, hash): one sort of owner and the hash's first 48 bits, which nearly always decide."""
    if len(owners) and int(owners.max()) < 1 << 16:
        order = np.argsort((owners.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16)))
        h, o = hashes[order], owners[order]
        if not ((o[1:] == o[:-1]) & (h[1:] >> np.uint64(16) == h[:-1] >> np.uint64(16)) & (h[1:] != h[:-1])).any():
            return order
    return np.lexsort((hashes, owners))


def shingle_sets(texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, sorted within each text, and how many each has."""
    words, counts = word_hashes(texts, lower=True)
    owner = np.repeat(np.arange(len(counts)), counts)
    n = max(0, len(words) - size + 1)
    inside = np.flatnonzero(owner[:n] == owner[size - 1:]) if n else np.empty(0, dtype=np.int64)
    hashes, owners = window_hashes(words, size)[inside] if n else np.empty(0, np.uint64), owner[inside]
    starts = np.cumsum(counts) - counts
    for k in range(1, size):  # texts of fewer words: one shingle of all of them
        short = np.flatnonzero(counts == k)
        if len(short):
            h = np.full(len(short), k, dtype=np.uint64)
            for i in range(k):
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[starts[short] + i])
            hashes, owners = np.concatenate([hashes, h]), np.concatenate([owners, short])
    order = by_owner(hashes, owners)
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[new], np.bincount(owners[new], minlength=len(counts))


def column_counter(size: int, bits: int):
    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes, counts = np.unique(np.concatenate(held), return_counts=True)
        block, key = block_and_key(hashes, bits)
        bounds = np.searchsorted(block, np.arange((1 << bits) + 1))
        for b in range(1 << bits):
            part = slice(bounds[b], bounds[b + 1])
            if bounds[b + 1] > bounds[b]:
                once = counts[part] == 1
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([b], pa.int32()), "once": pa.array([key[part][once].tobytes()], pa.binary()),
                    "more": pa.array([key[part][~once].tobytes()], pa.binary()),
                    "counts": pa.array([counts[part][~once].astype(np.uint32).tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in text_chunks(batches):
            held.append(shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), size)[0])
            total += len(held[-1])
            if total > HELD_KEYS:
                yield from send(held)
                held, total = [], 0
        if total:
            yield from send(held)

    return run


def column_writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                blobs.setdefault(row["block"], []).append(row)
        for b in sorted(blobs):
            rows = blobs.pop(b)
            once = np.concatenate([np.frombuffer(r["once"], np.uint32) for r in rows])
            more = np.concatenate([np.frombuffer(r["more"], np.uint32) for r in rows])
            counts = np.concatenate([np.ones(len(once), np.int64)] + [np.frombuffer(r["counts"], np.uint32) for r in rows])
            keys = np.concatenate([once, more])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            total = np.add.reduceat(counts, starts)
            live = total > 1
            put_array(f"{folder}/columns-{b}.npy", keys[starts][live])
            put_array(f"{folder}/levels-{b}.npy", np.log2(total[live]).astype(np.uint8))
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "live": pa.array([int(live.sum())], pa.int64())})

    return run


def signature(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums over each set."""
    starts = np.cumsum(counts) - counts
    out = []
    for salt in (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)):
        sums = np.zeros(len(counts), dtype=np.uint64)
        if len(hashes):
            sums[counts > 0] = np.add.reduceat(mixed(hashes ^ salt), starts[counts > 0])
        out.append(sums)
    return out[0], out[1]


def bitmaps(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A bitmap per set in which each shingle sets one bit."""
    out = np.zeros(n * BITMAP, dtype=np.uint64)
    bit = mixed(hashes ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(52)  # 4,096 bits
    np.bitwise_or.at(out, owner * BITMAP + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.view(np.int64)


def set_maker(folder: str, size: int, bits: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, tuple] = {}

        def levels(hashes: np.ndarray) -> np.ndarray:
            """0 for a column of one document, else 1 + log2 of its count."""
            block, key = block_and_key(hashes, bits)
            order = np.argsort(hashes)  # block and key are the first bits of the hash
            bounds = np.searchsorted(block[order], np.arange((1 << bits) + 1))
            out = np.zeros(len(hashes), dtype=np.int64)
            for b in range(1 << bits):
                rows = order[bounds[b]:bounds[b + 1]]
                if not len(rows):
                    continue
                if b not in opened:
                    opened[b] = map_array(f"{folder}/columns-{b}.npy"), map_array(f"{folder}/levels-{b}.npy")
                table, level = opened[b]
                if len(table):
                    at = np.minimum(np.searchsorted(table, key[rows]), len(table) - 1)
                    hit = np.asarray(table[at]) == key[rows]
                    out[rows[hit]] = 1 + np.asarray(level[at[hit]]).astype(np.int64)
            return out

        for batch in text_chunks(batches):
            hashes, counts = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), size)
            s1, s2 = signature(hashes, counts)
            owner = np.repeat(np.arange(len(counts)), counts)
            bits_of = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * BITMAP, pa.int32()), pa.array(
                bitmaps(hashes, owner, len(counts))))
            level = levels(hashes)
            order = np.argsort(owner * 64 + level, kind="stable")  # hashes are in order within each owner
            hashes, level = hashes[order], level[order]
            place = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
            reach = counts - (counts * percent + 99) // 100 + 1
            use = (place < reach[owner]) & (level > 0)
            per_doc = np.bincount(owner[use], minlength=len(counts))
            columns = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(per_doc)]), pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(hashes[use].view(np.int64)), pa.array(place[use], pa.int32())], ["col", "at"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(counts, pa.int64()), pa.array(s1.view(np.int64)),
                 pa.array(s2.view(np.int64)), bits_of, columns],
                ["doc_id", "text_key", "n_shingles", "s1", "s2", "bits", "columns"])

    return run


def overlap_counter(size: int, percent: int):
    """Count the overlap of the two texts of each row over their whole sets; rows that link stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_chunks([batch], "left"):
                left, n = shingle_sets(piece.column("left").cast(pa.binary()).to_pylist(), size)
                right, m = shingle_sets(piece.column("right").cast(pa.binary()).to_pylist(), size)
                keys = np.concatenate([left, right])
                owner = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)])
                order = np.lexsort((keys, owner))
                keys, owner = keys[order], owner[order]
                both = np.bincount(owner[1:][(keys[1:] == keys[:-1]) & (owner[1:] == owner[:-1])], minlength=len(n))
                link = 100 * both >= percent * (n + m - both)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("a").filter(pa.array(link)), piece.column("b").filter(pa.array(link)), pa.array(both[link])],
                    ["a", "b", "overlap"])

    return run


def linked(pairs: DataFrame, bodies: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    spelled = pairs.join(bodies.toDF("a", "left"), "a").join(bodies.toDF("b", "right"), "b").select("a", "b", "left", "right")
    return stored(spelled.mapInArrow(overlap_counter(size, percent), "a long, b long, overlap long"), "links")


def class_partners(placed: DataFrame, turn: int) -> DataFrame:
    """(class, a, b): rows b of a class and a of another one that have a column in common.

    Only columns of more than ``CROWD`` classes count; what the others have in common is listed cheaply, each pair once.
    In each column every class but the largest meets the largest one there, by one row of its own and ``TRIES`` rows of
    that one, which hashes of the rows and of ``turn`` choose; so a column gives at most ``TRIES`` pairs for each class that
    it has, and each turn tries other rows.
    """
    lots = [F.min_by("row", F.xxhash64(F.col("row"), F.lit(TRIES * turn + k))) for k in range(TRIES)]
    by_class = placed.groupBy("col", "class").agg(F.array(*lots).alias("some"), F.count("*").alias("rows"))
    largest = by_class.groupBy("col").agg(F.max(F.struct("rows", "class", "some")).alias("s"), F.count("*").alias("classes")).filter(
        F.col("classes") > CROWD)
    met = by_class.join(largest.select("col", "s"), "col").filter(F.col("class") != F.col("s.class"))
    return met.select("class", F.explode(F.array_distinct("s.some")).alias("a"), F.get("some", F.lit(0)).alias("b")).distinct()


def judge_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, component_id, and the links found at its set."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"),
                       F.col(text).cast("string").alias("text"))
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    bits = max(0, math.ceil(math.log2(max(1, chars / 6 / WORDS_PER_BLOCK))))
    folder = array_uri(scratch_dir(spark, "columns"))
    counted = rows.select("text").mapInArrow(column_counter(size, bits), "block int, once binary, more binary, counts binary")
    stored(counted.repartitionById(1 << bits, F.col("block")).mapInArrow(column_writer(folder), "block int, live long"), "column-blocks")
    sets = stored(rows.mapInArrow(set_maker(folder, size, bits, percent), SET_SCHEMA), "sets")

    # Equal sets are one row of the product, named by the first half of their hash.
    whole = ["s1", "s2", "n_shingles"]
    members = stored(sets.filter("n_shingles > 0").groupBy(*whole).agg(
        F.first("columns").alias("columns"), F.first("bits").alias("bits"), F.min(F.struct("doc_id", "text_key")).alias("one")), "equal-sets")
    # Each entry knows the columns that its row has just before it in the order.
    before = F.slice(F.transform("columns", lambda c: c["col"]), F.greatest(F.lit(1), F.col("i") + 1 - BEFORE), F.least("i", F.lit(BEFORE)))
    entries = members.select(
        F.col("s1").alias("row"), F.col("n_shingles").alias("n"), "one", "columns", F.posexplode("columns").alias("i", "c")
    ).select("row", "n", "one", "c.col", "c.at", before.alias("before"))

    def possible(n: str, m: str):
        return (100 * F.col(n) >= percent * F.col(m)) & (100 * F.col(m) >= percent * F.col(n))

    first = entries.groupBy("col").agg(F.min(F.struct("row", "n")).alias("f"), F.max("row").alias("last")).filter(
        F.col("f.row") < F.col("last")).select("col", F.col("f.row").alias("a"), F.col("f.n").alias("m"))
    first = stored(first, "first-rows")
    entries = stored(entries.join(first.select("col"), "col", "left_semi"), "entries")
    named = entries.select("row", "one.*").distinct().toDF("row", "one_id", "one_key")
    bodies = stored(rows.join(named, F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("text_key") == F.col("one_key"))
                              ).dropDuplicates(["row"]).select("row", "text"), "row-texts")
    stars = entries.join(first, "col").filter((F.col("row") > F.col("a")) & possible("n", "m")).groupBy(
        F.col("row").alias("b"), "a").agg(F.count("*").alias("shared"))
    stars = stored(stars.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b"), "star-pairs")
    links = linked(stars, bodies, size, percent).select("a", "b")
    classes = components(links).toDF("row", "class")

    # Every bit in which the bitmaps differ stands for at least one shingle that only one set has.
    apart = sum((F.bit_count(F.get("ba", F.lit(i)).bitwiseXOR(F.get("bb", F.lit(i)))) for i in range(BITMAP)), F.lit(0))
    near_bits = possible("na", "nb") & ((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb")))
    sizes = members.select(F.col("s1").alias("row"), F.col("n_shingles").alias("size"), "bits")
    crowded = entries.groupBy("col").agg(F.count("*").alias("rows")).filter(F.col("rows") > CROWD).select("col")
    crowded = stored(entries.select("col", "row").join(crowded, "col", "left_semi"), "crowded-entries")
    few, turn = min(FEW, crowded.agg(F.countDistinct("row")).first()[0] / SHARE), 0
    while True:
        placed = crowded.join(classes, "row", "left").withColumn("class", F.coalesce("class", "row"))
        partners = class_partners(placed, turn).join(sizes.toDF("a", "na", "ba"), "a").join(sizes.toDF("b", "nb", "bb"), "b").filter(near_bits)
        nearest = partners.groupBy("class").agg(F.min_by(F.struct("a", "b"), F.struct(apart, F.xxhash64("a", "b"))).alias("p"))
        nearest = stored(nearest.select("p.a", "p.b"), "class-partners")
        found = linked(nearest, bodies, size, percent).select("a", "b")
        links, turn, n_found = links.union(found), turn + 1, found.count()
        if n_found:
            classes = components(links).toDF("row", "class")
        if n_found < few or ENOUGH * n_found <= nearest.count():
            break
    placed = stored(entries.drop("one", "columns").join(classes, "row", "left").withColumn("class", F.coalesce("class", "row")), "entry-classes")
    mixed_columns = placed.groupBy("col").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("col")
    open_entries = stored(placed.join(mixed_columns, "col", "left_semi"), "open-entries")
    sized_entries = open_entries.join(members.select(F.col("s1").alias("row"), "bits"), "row")
    # A pair is found from the smaller set's side, of which fewer columns are enough.
    enough = F.col("n") - F.floor((2 * percent * F.col("n") + 99 + percent) / (100 + percent)) + 1
    left = sized_entries.filter(F.col("at") < enough).select(
        "col", F.col("row").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"), F.col("class").alias("ca"), F.col("bits").alias("ba"),
        F.col("before").alias("la"))
    right = sized_entries.select(
        "col", F.col("row").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"), F.col("class").alias("cb"), F.col("bits").alias("bb"),
        F.col("before").alias("lb"))
    # The shared column, and at most what comes after it in both, can overlap, beyond what came before.
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + F.least("pa", "pb")
    pairs = left.join(right, "col").filter(
        (F.col("ca") != F.col("cb")) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
        & ((100 + percent) * most >= percent * (F.col("na") + F.col("nb")))
        & near_bits
        & ~F.arrays_overlap("la", "lb"))  # a linked pair that shares an earlier column is found there
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "open-pairs")
    links = links.union(linked(pairs, bodies, size, percent).select("a", "b"))

    labels = components(links).toDF("s1", "label")
    degrees = links.select(F.col("a").alias("s1")).union(links.select("b")).groupBy("s1").agg(F.count("*").alias("n_links"))
    found = sets.drop("columns", "bits").join(labels.join(degrees, "s1", "left"), "s1", "left").withColumn(
        "label", F.when(F.col("n_shingles") > 0, F.coalesce("label", "s1")))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    smallest = found.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(place).alias("first"))
    return found.join(smallest, "label", "left").select(
        "doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("first").isNull() | F.col("first").eqNullSafe(place)).alias("is_first"))


def keep_first(docs: DataFrame, verdicts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one with its smallest id and text hash; of rows with equal id and text one stays."""
    dropped = verdicts.filter("not is_first")
    kept = keep_rows(docs, dropped, doc_id, text)
    a, b = unused_name(kept, "_one_id"), unused_name(kept, "_one_key")
    return kept.withColumns({a: F.col(doc_id), b: F.xxhash64(F.col(text))}).dropDuplicates([a, b]).drop(a, b)
