"""Line dedup: a segment-partition join of all lines within ``edits`` edits of each other.

A line is a ``\\n``-separated part of a text without spaces, tabs and CR at its ends. Every distinct line of at least
``min_chars`` code points is split into edits + 1 segments of nearly equal length. Two lines within ``edits`` edits share
a whole segment of the shorter one, at a place that the segment's number and the difference of the lengths bound: the
substring index holds (length, segment number, hash of the segment), and a line probes it for its own length and the
``edits`` next shorter ones at those places only. Keys that only one line has are dropped before texts are fetched. Pairs
of lines that meet at a key are verified as a condition of that join, so that only links come out of it, by a bit-parallel
edit distance over a band of 2 * edits + 1 diagonals, an expression on one word per column of the band. Verified pairs give classes (connected
components); of a class the first line by (document id, text hash, line number) stays, the others are removed.

``by_length`` lets the number of edits follow the length of a pair's shorter line: none below ``min_chars`` (lines without
a letter or digit stay there), ``edits`` from ``min_chars`` on, and one for each ``EDIT_EVERY`` code points of lines of
``LONG_FROM`` to ``LONG_TO``; still longer lines are compared within ``edits`` as well. Long lines within one edit for each
``EDIT_EVERY`` code points have a run of 30 code points in common. Of each run the smallest hash of its windows of ``GRAM``
is a mark of the line, so both lines have it. Tasks send marks with 32-bit tags of their lines in packed blocks, and write
the marks that lines of two tags have as sorted arrays that workers map; only these become rows (a false mark adds a pair
to verify; two lines of one tag are taken for one, one time in 2^32), and of these only as many of a line, rarest first, as
near lines can't miss: lines that have no more than a short passage in common don't meet. A pair of lines of like length meets
at a common mark unless both have the same such mark before it, and is then verified by its edit distance. This listing of
all pairs (``long_links``) alone is in Arrow.

``judge_lines`` needs classes, not pairs: ``long_class_links`` makes marks by expressions and compares lines of different
classes only. Its windows begin after a space; where ``REACH`` code points have no space they begin anywhere. Lines have marks
by ``BANDS`` of length, with windows as long as the run allows that near lines of the band have in common at least (``GRAM`` code
points in the first band, up to 25), so lines that share a short passage or are of other lengths don't meet.

Defined cases: null texts have no lines; lines shorter than ``min_chars`` are in no class and always stay; a null document
id comes before all others; rows with the same id and text are one document, whose copies keep the same lines; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropline.llm.common import (
    array_uri, block_and_key, components, documents_of, map_array, mixed, put_array, scratch_dir, stored, text_chunks,
)

EDITS = 2
MIN_CHARS = 24
#: Rows of one or two longs that may be broadcast.
BROADCAST_KEYS = 1_000_000
#: Long lines: code points for each edit, and the lengths from and below which that holds.
EDIT_EVERY, LONG_FROM, LONG_TO = 40, 120, 4000
#: Code points of a hashed window, and windows of a run: any line of LONG_FROM has GRAM + RUN - 1 code points between its edits.
GRAM, RUN = 16, 15
#: Window starts of which one is a mark: a run of GRAM + REACH code points is in both of two near lines.
REACH = RUN - 1
#: Lengths from which lines meet at marks of their own: two lines meet at marks of the shorter one's band.
BANDS = (LONG_FROM, 140, 160, 180, 200, 220, 240, 280, 320, 400, 500, 625, 780, 975, 1220, 1525, 1900, 2400, 3000, LONG_TO)
#: Orders of lines of equal length in a turn over the marks; a mark has one of them.
TRIES = 8
#: Lines of a mark up to which pairs are listed before they are compared.
CROWD = 64
#: Marks before an entry that are looked at to list a pair once, not at every mark that it shares.
BEFORE = 8
#: As many of them are looked at in marks of few lines, where a pair that is listed twice costs less than longer rows.
NEXT = 2
#: Characters that are counted before long lines are compared; all others are counted together.
COUNTED = " abcdefghiklmnoprstuvwy"
#: Marks of a block, whose lines are counted in one task, and marks that a counting task holds before it sends them.
MARKS_PER_BLOCK = HELD_MARKS = 2_000_000
#: Lines of one key that a task compares with the key's index rows.
SPLIT = 500


def segment(length: Column, number: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment ``number`` of a line; the longer segments come last."""
    size = F.floor(length / parts).cast("int")
    long_from = parts - length % parts
    return (size * number + F.greatest(F.lit(0), F.lit(number) - long_from)).cast("int"), (
        size + F.when(F.lit(number) >= long_from, 1).otherwise(0)).cast("int")


def probe_places(edits: int) -> list[tuple[int, int, int]]:
    """(difference of lengths, segment number, shift) of all probes.

    Left of a segment number i (from 0) at most i edits may lie, and right of it at most edits - i.
    """
    return [(d, i, shift) for d in range(edits + 1) for i in range(edits + 1)
            for shift in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1)]


def probe_key(line: Column, length: Column, difference: int, number: int, shift: int, parts: int) -> Column:
    """Hash of what must equal segment ``number`` of a line that is ``difference`` shorter; null where there is no place."""
    shorter = length - difference
    start, size = segment(shorter, number, parts)
    at = start + shift
    return F.when((at >= 0) & (at + size <= length) & (size > 0), F.xxhash64(
        shorter, F.lit(number), F.substring(line, at + 1, size)))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix, by halving steps; ``b`` is not the longer one."""
    bits = F.length(F.bin(F.length(b))) - 1
    steps = F.transform(F.sequence(bits, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(
        (n + step <= F.length(b)) & (F.substring(a, n + 1, step) == F.substring(b, n + 1, step)), step).otherwise(0))


def banded_distance(longer: Column, shorter: Column, edits: int) -> Column:
    """Edit distance of two lines whose lengths differ by at most ``edits``, right where it is at most ``edits``.

    What both lines begin and end with is left out first, but for ``edits`` + 1 code points. Bit k of a word stands for
    row j - edits + k of column j. Vertical differences of +1 and -1 are two words; the value followed is that of the
    band's last row, and of the last row of all once the band reaches it. Once it is too high to come down again, the
    columns that follow are passed over.
    """
    width = 2 * edits + 1
    ones, top = (1 << width) - 1, 1 << (width - 1)
    chars = lambda c: F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))

    def within(value: Column, use) -> Column:
        """``use(value)`` with the value worked out once."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def middle(p: Column) -> Column:
        spare = F.length(p["a"]) - (edits + 1)
        start = F.greatest(F.lit(0), F.least(common_prefix(p["a"], p["b"]), spare))
        return within(F.struct(start.alias("s"), p["a"].alias("a"), p["b"].alias("b")), lambda q: within(
            F.struct(q["s"].alias("s"), F.greatest(F.lit(0), F.least(F.length(q["a"]) - (edits + 1) - q["s"], common_prefix(
                F.reverse(F.substring(q["a"], q["s"] + 1, F.length(q["a"]))), F.reverse(F.substring(q["b"], q["s"] + 1, F.length(q["b"])))))
                ).alias("e"), q["a"].alias("a"), q["b"].alias("b")),
            lambda r: F.struct(chars(F.substring(r["a"], r["s"] + 1, F.length(r["a"]) - r["s"] - r["e"])).alias("a"),
                               chars(F.substring(r["b"], r["s"] + 1, F.length(r["b"]) - r["s"] - r["e"])).alias("b"))))

    def flip(x: Column) -> Column:
        return F.lit(ones) - x

    def advance(state: Column, j: Column, rows: Column, columns: Column, n: Column) -> Column:
        char = F.get(columns, j)
        match = F.lit(0)
        for k in range(width):
            match = match + F.when((j + (k - edits) >= 0) & (F.get(rows, j + (k - edits)) == char), 1 << k).otherwise(0)
        step1 = F.struct(match.alias("x"), state["vp"].alias("vp"), state["vn"].alias("vn"), state["d"].alias("d"),
                         state["row"].alias("row"))
        # Named steps, so that each is worked out once.
        steps = F.transform(F.array(step1), lambda s: F.struct(
            ((((s["x"].bitwiseAND(s["vp"])) + s["vp"]).bitwiseAND(ones)).bitwiseXOR(s["vp"])
             .bitwiseOR(s["x"]).bitwiseOR(s["vn"])).alias("d0"), s["vp"].alias("vp"), s["vn"].alias("vn"),
            s["d"].alias("d"), s["row"].alias("row")))
        steps = F.transform(steps, lambda s: F.struct(
            s["d0"].alias("d0"), s["vn"].bitwiseOR(flip(s["d0"].bitwiseOR(s["vp"]))).alias("hp"),
            s["d0"].bitwiseAND(s["vp"]).alias("hn"), s["d"].alias("d"), s["row"].alias("row")))
        diagonal = j < n - edits
        steps = F.transform(steps, lambda s: F.struct(
            s["hn"].bitwiseOR(flip(F.shiftright(s["d0"], 1).bitwiseOR(s["hp"]))).alias("vp"),
            F.shiftright(s["d0"], 1).bitwiseAND(s["hp"]).alias("vn"),
            (s["d"] + F.when(diagonal, F.when(s["d0"].bitwiseAND(top) == 0, 1).otherwise(0)).otherwise(
                F.when(s["hp"].bitwiseAND(s["row"]) != 0, 1).otherwise(0)
                - F.when(s["hn"].bitwiseAND(s["row"]) != 0, 1).otherwise(0))).alias("d"),
            F.when(diagonal, s["row"]).otherwise(F.shiftright(s["row"], 1)).alias("row")))
        return F.get(steps, F.lit(0))

    first = F.struct(F.lit(ones - ((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("d"),
                     F.lit(top >> 1).alias("row"))
    def distance(p: Column) -> Column:
        hopeless = 2 * edits + F.size(p["b"]) - F.size(p["a"])
        return F.when(F.size(p["b"]) == 0, F.size(p["a"])).otherwise(F.aggregate(
            F.sequence(F.lit(0), F.size(p["b"]) - 1), first, lambda state, j: F.when(state["d"] > hopeless, state).otherwise(
                advance(state, j, p["a"], p["b"], F.size(p["a"]))), lambda state: state["d"]))

    return within(F.struct(longer.alias("a"), shorter.alias("b")), lambda p: within(middle(p), distance))


def lines_of(docs: DataFrame, min_chars: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, line_no, line, line_key) of all lines that are long enough."""
    rows = documents_of(docs, doc_id, text).select("doc_id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    loose = F.lit(False)  # few lines have something to trim, and trimming costs more than looking
    for blank in " \t\r":
        loose = loose | F.startswith("line", F.lit(blank)) | F.endswith("line", F.lit(blank))
    trimmed = F.when(loose, F.btrim("line", F.lit(" \t\r"))).otherwise(F.col("line"))
    return rows.select("doc_id", "text_key", "line_no", trimmed.alias("line")).filter(
        F.length("line") >= min_chars).withColumn("line_key", F.xxhash64("line"))


def covered_runs(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mark, number of its line, runs that it covers) in text order: the smallest hash of each ``RUN`` neighbouring windows."""
    sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    h = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(lines)), sizes)
    size, factor = 1, 0x9E3779B97F4A7C15
    while size < GRAM and len(h) > size:  # windows of twice the size; GRAM is a power of two
        h = h[:-size] * np.uint64(factor) + h[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)
    low, size = mixed(h), 1
    while 2 * size <= RUN:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    low = np.minimum(low[:len(low) - (RUN - size)], low[RUN - size:])
    n = max(0, len(owner) - (GRAM + RUN - 2))
    low, first, last = low[:n], owner[:n], owner[len(owner) - n:]
    inside = first == last
    new = inside.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~inside[:-1] | (first[1:] != first[:-1])
    return low[new], first[new], np.bincount(np.cumsum(new[inside]) - 1, minlength=int(new.sum()))


def mark_runs(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(mark, number of its line) in text order."""
    return covered_runs(lines)[:2]


def needed(marks: np.ndarray, owner: np.ndarray, covers: np.ndarray, counts: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """The places, in text order, of those live marks of each line of which a near line has one, each mark of a line once.

    An edit is in GRAM + RUN - 1 runs at most, so two near lines of which one has n code points have runs in common, at
    least n * 10 / 41 less 29 of them (the shorter one has 40 / 41 of the longer one's length). Marks are ordered by the number
    of their lines; those at the end that cover fewer runs together than that can't be all that two lines have in common.
    """
    run = GRAM + RUN - 1
    grown = EDIT_EVERY + 1  # as many code points of the longer line stand for EDIT_EVERY of the shorter one
    least = np.maximum(1, -(((run - 1) * grown - (EDIT_EVERY - run) * chars.astype(np.int64)) // grown))
    order = np.lexsort((np.arange(len(marks)), marks, owner))
    if not len(order):
        return order
    m, o = marks[order], owner[order]
    new = np.concatenate([[True], (m[1:] != m[:-1]) | (o[1:] != o[:-1])])
    places, total = order[new], np.add.reduceat(covers[order], np.flatnonzero(new))
    ranked = np.lexsort((marks[places], counts[places], owner[places]))
    places, total = places[ranked], total[ranked]
    after = np.cumsum(total[::-1])[::-1]  # runs of this mark and all after it, lines that follow included
    ends = np.searchsorted(owner[places], np.arange(len(chars)), side="right")
    after = after - np.concatenate([after, [0]])[ends[owner[places]]]
    return np.sort(places[after >= least[owner[places]]])


def mark_counter(bits: int):
    """Blocks of (mark, tag of the line). Of a mark in many lines a task sends two tags at most: two make it live."""
    def send(held: list[np.ndarray], blocks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        block, pairs = np.concatenate(blocks), np.concatenate(held)
        order = np.lexsort((pairs, block))
        block, pairs = block[order], pairs[order]
        once = np.concatenate([[True], (block[1:] != block[:-1]) | (pairs[1:] != pairs[:-1])])  # a line may have a mark twice
        block, pairs = block[once], pairs[once]
        key = pairs >> np.uint64(32)
        change = (block[1:] != block[:-1]) | (key[1:] != key[:-1])
        keep = np.concatenate([[True], change]) | np.concatenate([change, [True]])
        block, pairs = block[keep], pairs[keep]
        starts = np.searchsorted(block, np.arange((1 << bits) + 1))
        for b in np.unique(block).tolist():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "pairs": pa.array(
                [pairs[starts[b]:starts[b + 1]].tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blocks, total = [], [], 0
        for batch in text_chunks(batches, "line"):
            marks, owner = mark_runs(texts_of(batch))
            tags = mixed(batch.column("line_key").to_numpy().view(np.uint64)) >> np.uint64(32)
            block, key = block_and_key(marks, bits)
            held.append((key.astype(np.uint64) << np.uint64(32)) | tags[owner])
            blocks.append(block)
            total += len(block)
            if total > HELD_MARKS:
                yield from send(held, blocks)
                held, blocks, total = [], [], 0
        if total:
            yield from send(held, blocks)

    return run


def mark_writer(folder: str):
    """The marks of each block that different lines have, as one sorted array, and beside it the number of tags sent for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                blobs.setdefault(row["block"], []).append(row["pairs"])
        for b in sorted(blobs):
            pairs = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in blobs.pop(b)]))
            key = (pairs >> np.uint64(32)).astype(np.uint32)
            live, lines = np.unique(key, return_counts=True)
            live, lines = live[lines > 1], lines[lines > 1]
            put_array(f"{folder}/marks-{b}.npy", live)
            put_array(f"{folder}/counts-{b}.npy", np.minimum(lines, 65535).astype(np.uint16))
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "live": pa.array([len(live)], pa.int64())})

    return run


def live_marks(folder: str, bits: int):
    """(line, length, mark, the mark before it) of the ``needed`` live marks of each line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, tuple] = {}
        for batch in text_chunks(batches, "line"):
            keys = batch.column("line_key").to_numpy()
            once = np.unique(keys, return_index=True)[1]
            batch = batch.take(pa.array(once))
            keys = keys[once]
            marks, owner, covers = covered_runs(texts_of(batch))
            block, key = block_and_key(marks, bits)
            counts = np.zeros(len(marks), dtype=np.int64)  # 0: a mark of one line
            order = np.argsort(block, kind="stable")
            starts = np.searchsorted(block[order], np.arange((1 << bits) + 1))
            for b in np.unique(block).tolist():
                rows = order[starts[b]:starts[b + 1]]
                if b not in opened:
                    opened[b] = map_array(f"{folder}/marks-{b}.npy"), map_array(f"{folder}/counts-{b}.npy")
                table, lines = opened[b]
                if len(table):
                    at = np.minimum(np.searchsorted(table, key[rows]), len(table) - 1)
                    hit = np.asarray(table[at]) == key[rows]
                    counts[rows[hit]] = np.asarray(lines[at[hit]])
            live = np.flatnonzero(counts)
            use = live[needed(marks[live], owner[live], covers[live], counts[live], batch.column("chars").to_numpy())]
            marks, owner = marks[use], owner[use]
            alone = np.ones(len(marks), dtype=bool)
            alone[1:] = owner[1:] != owner[:-1]
            before = np.concatenate([marks[:1], marks[:-1]]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[owner]), batch.column("chars").take(pa.array(owner)), pa.array(marks.view(np.int64)), pa.array(before, mask=alone)],
                ["line_key", "chars", "mark", "before"])

    return run


def texts_of(batch: pa.RecordBatch) -> list[str]:
    return [x.decode("utf-8", "replace") for x in batch.column("line").cast(pa.binary()).to_pylist()]


def character_counts(line: Column) -> Column:
    """How often each character of ``COUNTED`` and how many others are in a line of at most ``LONG_TO`` + a few code points."""
    some = [F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))) for c in COUNTED]
    others = F.length(F.translate(line, COUNTED, ""))
    return F.array(*[c.cast("short") for c in (*some, others)])


def long_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (a, b) of keys of different long lines within one edit for each ``EDIT_EVERY`` code points of the shorter one."""
    sized = lambda df: F.broadcast(df) if df.count() <= BROADCAST_KEYS else df
    allowed = lambda chars: F.floor(chars / EDIT_EVERY).cast("int")
    every = lines_of(docs, LONG_FROM, doc_id, text).filter(F.length("line") <= LONG_TO + LONG_TO // EDIT_EVERY)
    lines = every.select("line_key", F.length("line").alias("chars"), "line")
    # Twice RUN / 2 + 1 code points for a mark, on average.
    n_marks = docs.agg(F.coalesce(F.sum(F.length(F.col(text))), F.lit(0))).first()[0] * 2 / (RUN + 1)
    bits = max(0, math.ceil(math.log2(max(1, n_marks / MARKS_PER_BLOCK))))
    folder = array_uri(scratch_dir(docs.sparkSession, "marks"))
    counted = lines.select("line_key", "line").mapInArrow(mark_counter(bits), "block int, pairs binary")
    stored(counted.repartitionById(1 << bits, F.col("block")).mapInArrow(mark_writer(folder), "block int, live long"), "mark-blocks")
    entries = lines.mapInArrow(live_marks(folder, bits), "line_key long, chars int, mark long, before long")
    entries = stored(entries.dropDuplicates(["line_key", "mark"]), "live-marks")  # a line of many documents is one line
    crowds = entries.groupBy("mark").agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT).select(
        "mark", F.ceil(F.col("n") / SPLIT).cast("int").alias("salts"))  # at most one for each SPLIT entries
    entries = entries.join(sized(stored(crowds, "crowded-marks")), "mark", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    # Lines whose lengths differ by a fortieth or less are in one step of lengths or in two that follow each other. Steps part
    # the lines of marks that many lines have; those of other marks are in one step.
    step = F.when(F.col("salts") > 1, F.floor(F.log(F.col("chars").cast("double")) / F.log(F.lit(1.04))).cast("int")).otherwise(0)
    steps = F.when(F.col("salts") > 1, F.array(step, step - 1)).otherwise(F.array(F.lit(0)))
    index = entries.select("mark", step.alias("step"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                           F.col("line_key").alias("a"), F.col("chars").alias("a_chars"), F.col("before").alias("a_before"))
    probes = entries.select("mark", F.explode(steps).alias("step"), F.pmod("line_key", "salts").cast("int").alias("salt"),
                            F.col("line_key").alias("b"), F.col("chars").alias("b_chars"), F.col("before").alias("b_before"))
    alike = (F.col("a_chars") < LONG_TO) & (F.col("b_chars") - F.col("a_chars") <= allowed(F.col("a_chars"))) & (
        (F.col("a_chars") < F.col("b_chars")) | ((F.col("a_chars") == F.col("b_chars")) & (F.col("a") < F.col("b"))))
    first = ~F.coalesce(F.col("a_before") == F.col("b_before"), F.lit(False))  # or the pair meets at the mark before, too
    pairs = stored(index.join(probes, (index["mark"] == probes["mark"]) & (index["step"] == probes["step"]) & (
        index["salt"] == probes["salt"]) & alike & first).select("a", "b").distinct(), "long-pairs")
    wanted = pairs.select(F.col("a").alias("line_key")).union(pairs.select("b")).distinct()
    bodies = stored(lines.select("line_key", "line").join(sized(stored(wanted, "wanted-lines")), "line_key", "left_semi").groupBy(
        "line_key").agg(F.first("line").alias("line")).withColumn("counts", character_counts(F.col("line"))), "long-lines")
    texts = lambda key, line, counts: bodies.toDF(key, line, counts)
    most = allowed(F.length("shorter"))
    longer_by = F.length("longer") - F.length("shorter")
    apart = F.when(alike_counts("shorter_counts", "longer_counts", most, longer_by), F.call_function("levenshtein", F.col("shorter"), F.col("longer"), most))
    return stored(pairs.join(texts("a", "shorter", "shorter_counts"), "a").join(texts("b", "longer", "longer_counts"), "b").select(
        "a", "b", apart.alias("distance")).filter("distance >= 0"), "long-links")


def common_run(band: int) -> int:
    """Code points in one piece that a line of a band has in common with any line that is near and not shorter, at least."""
    pieces = [(n, n // EDIT_EVERY + 1) for n in range(BANDS[band], BANDS[band + 1])]
    return min(-((k - 1 - n) // k) for n, k in pieces)


def bands_of(chars: Column) -> Column:
    """(low, gram) of the bands whose marks a line has: its own one, and that of the shortest lines that can be near it."""
    found = []
    for band, (low, high) in enumerate(zip(BANDS, BANDS[1:])):
        of = F.struct(F.lit(low).alias("low"), F.lit(common_run(band) - REACH).alias("gram"))
        found.append(F.when((chars >= low) & (chars < high + high // EDIT_EVERY), of))
    return F.array_compact(F.array(*found))


def spaced_marks(line: Column, gram: Column) -> Column:
    """Hashes of the windows after the spaces of a line of which one is the smallest in a reach of ``REACH`` code points.

    A window is left out where the nearest smaller ones of the two before and the two after it leave no reach without them.
    """
    windows = F.regexp_extract_all(line, F.concat(F.lit("(?s)(?<= )(?=(.{"), gram, F.lit("}))")), F.lit(1))
    # With each hash the distance to the next space, where it is near.
    hashed = F.transform(windows, lambda x: F.struct(F.xxhash64(x).alias("h"), F.nullif(F.instr(x, " "), F.lit(0)).alias("d")))

    def chosen(w: Column) -> Column:
        def stays(x: Column, i: Column) -> Column:
            at = lambda k: F.get(w, i + k)
            left = F.when(at(-1)["h"] < x["h"], at(-1)["d"]).when(at(-2)["h"] < x["h"], at(-1)["d"] + at(-2)["d"])
            right = F.when(at(1)["h"] < x["h"], x["d"]).when(at(2)["h"] < x["h"], x["d"] + at(1)["d"])
            return F.coalesce(left + right > REACH, F.lit(True))

        return F.transform(F.filter(w, stays), lambda x: x["h"])

    return F.get(F.transform(F.array(hashed), chosen), F.lit(0))


def unspaced_marks(line: Column, gram: Column) -> Column:
    """Of each ``REACH`` code points without a space the smallest hash of the windows after them."""
    pieces = F.regexp_extract_all(line, F.concat(F.lit(f"(?s)(?:^|(?<= ))(?=([^ ]{{{REACH},}}.{{0,"), gram, F.lit("}))")), F.lit(1))
    windows = lambda x: F.transform(F.regexp_extract_all(
        x, F.concat(F.lit("(?s)(?<=.)(?=(.{"), gram, F.lit("}))")), F.lit(1)), lambda y: F.xxhash64(y))
    # A shorter piece is at the line's end, where no whole run is left.
    least = lambda w: F.when(F.size(w) >= REACH, F.transform(
        F.sequence(F.lit(1), F.size(w) - (REACH - 1)), lambda i: F.array_min(F.slice(w, i, REACH)))).otherwise(F.array().cast("array<long>"))
    # Neighbours mostly have the same one; it stays where it is new.
    once = lambda w: F.filter(w, lambda x, i: (i == 0) | (x != F.get(w, i - 1)))
    found = F.flatten(F.transform(F.transform(F.transform(pieces, windows), least), once))
    return F.when(F.rlike(line, F.lit(f"[^ ]{{{REACH}}}")), found).otherwise(F.array().cast("array<long>"))


def alike_counts(a: str, b: str, most: Column, longer_by: Column) -> Column:
    """Whether two lines whose lengths differ by ``longer_by`` can be within ``most`` edits by their ``character_counts``."""
    # Over the array and not column by column: code for each of them makes a method too long to be compiled.
    moved = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda n, x: n + x)
    return moved + longer_by <= 2 * most  # an exchanged character changes two counts by one; one that only makes lengths differ changes one


def long_marks(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mark, line_key, chars, n) of the marks at which long lines meet, n rows in all, and (line_key, line, chars, counts) of these lines."""
    banded = lines.select("line_key", "line", F.explode(bands_of(F.length("line"))).alias("band"))
    marks = banded.select("line_key", F.col("band.low").alias("low"), F.explode(F.concat(
        spaced_marks(F.col("line"), F.col("band.gram")), unspaced_marks(F.col("line"), F.col("band.gram")))).alias("mark"))
    marks = marks.select("line_key", F.xxhash64("mark", "low").alias("mark")).repartition("mark")
    shared = marks.groupBy("mark").agg(F.min("line_key").alias("low"), F.max("line_key").alias("high"), F.count("*").alias("n")).filter(
        "low < high").select("mark", "n")
    live = stored(marks.join(shared.hint("shuffle_hash"), "mark").groupBy("mark", "line_key").agg(F.first("n").alias("n")), "live-marks")
    wanted = stored(live.select("line_key").distinct(), "marked-lines")
    bodies = stored(lines.join(wanted.hint("shuffle_hash"), "line_key", "left_semi").groupBy("line_key").agg(F.first("line").alias("line")).select(
        "line_key", "line", F.length("line").alias("chars"), character_counts(F.col("line")).alias("counts")), "long-lines")
    return stored(live.join(bodies.select("line_key", "chars"), "line_key").select("mark", "line_key", "chars", "n"), "needed-marks"), bodies


def long_class_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Links (a, b, distance) of long lines, enough to join all that ``long_links`` joins, though not all pairs.

    In turns the lines of each mark are put in order of their lengths, in another order of equal ones each turn, and each
    meets the one before it, if that is in another class yet. The marks that still have several classes are then gone
    through in full: all pairs of lines of different classes there are compared.
    """
    allowed = lambda chars: F.floor(chars / EDIT_EVERY).cast("int")
    every = lines_of(docs, LONG_FROM, doc_id, text).filter(F.length("line") <= LONG_TO + LONG_TO // EDIT_EVERY)
    marks, bodies = long_marks(every.select("line_key", "line"))
    alike = lambda a, b: (F.col(a) < LONG_TO) & (F.col(b) - F.col(a) <= allowed(F.col(a)))

    def alike_lines(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(bodies.select(F.col("line_key").alias("a"), F.col("chars").alias("a_chars"), F.col("counts").alias("a_counts")), "a").join(
            bodies.select(F.col("line_key").alias("b"), F.col("chars").alias("b_chars"), F.col("counts").alias("b_counts")), "b")
        return stored(sides.filter(can_be_near("a", "b")).select("a", "b"), "class-pairs")

    def can_be_near(a: str, b: str) -> Column:
        return alike_counts(f"{a}_counts", f"{b}_counts", allowed(F.col(f"{a}_chars")), F.col(f"{b}_chars") - F.col(f"{a}_chars"))

    def compared(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(bodies.select(F.col("line_key").alias("a"), F.col("line").alias("shorter")), "a").join(
            bodies.select(F.col("line_key").alias("b"), F.col("line").alias("longer")), "b")
        apart = F.call_function("levenshtein", F.col("shorter"), F.col("longer"), allowed(F.length("shorter")))
        # As a list, so that it is worked out once and not in the filter too.
        return stored(sides.select("a", "b", F.explode(F.filter(F.array(apart), lambda x: x >= 0)).alias("distance")), "class-links")

    links = classes = None
    turn = 0
    while True:
        placed = marks.withColumn("class", F.col("line_key")) if classes is None else marks.join(
            classes, "line_key", "left").withColumn("class", F.coalesce("class", "line_key"))
        several = placed.groupBy("mark").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("mark")
        marks_left = stored(placed.join(several, "mark", "left_semi"), "open-marks")
        if links is not None and (n_found == 0 or n_found < marks_left.select("line_key").distinct().count()):
            break  # a turn costs more than it spares where it links fewer lines than are left
        order = Window.partitionBy("mark").orderBy("chars", F.xxhash64("line_key", F.pmod("mark", F.lit(TRIES)), F.lit(turn)))
        met = marks_left.select("mark", F.col("line_key").alias("b"), F.col("chars").alias("b_chars"), F.col("class").alias("b_class"), *[
            F.lag(x).over(order).alias(y) for x, y in (("line_key", "a"), ("chars", "a_chars"), ("class", "a_class"))])
        met = met.filter((F.col("a_class") != F.col("b_class")) & alike("a_chars", "b_chars")).select("a", "b").distinct()
        found = compared(alike_lines(met))
        links, turn, n_found = found if links is None else links.unionByName(found), turn + 1, found.count()
        classes = components(links).toDF("line_key", "class")
    # Each entry knows the marks that its line has just before it, rarest first.
    rarer = Window.partitionBy("line_key").orderBy("n", F.desc("mark")).rowsBetween(-BEFORE, -1)
    crowds = marks_left.groupBy("mark").agg(F.count("*").alias("rows")).select(
        "mark", (F.col("rows") > CROWD).alias("crowded"), F.ceil(F.col("rows") / SPLIT).cast("int").alias("salts"))
    rows = stored(marks_left.withColumn("before", F.collect_list("mark").over(rarer)).join(crowds, "mark"), "open-entries")

    # Two lines whose lengths differ by a fortieth or less are in one step of lengths or in two that follow each other.
    in_step = lambda chars: F.floor(F.log(chars.cast("double")) / F.log(F.lit(1.1))).cast("int")
    step, lowest = in_step(F.col("chars")), in_step(F.ceil(F.col("chars") * EDIT_EVERY / (EDIT_EVERY + 1)))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def met(entries: DataFrame, key: tuple[str, ...], near: Column, *more: str) -> DataFrame:
        """Pairs of lines of different classes that can be near, each at the rarest mark that both have."""
        named = lambda x: [F.col("line_key").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("chars", "class", "before", *more)]]
        own = {"mark": F.col("mark"), "step": step, "salt": F.explode(F.sequence(F.lit(0), F.col("salts") - 1))}
        index = entries.select(*[own[k].alias(k) for k in key], *named("a"))
        own |= {"step": F.explode(F.sequence(lowest, step)), "salt": F.pmod("line_key", "salts").cast("int")}
        probes = entries.select(*[own[k].alias(k) for k in key], *named("b"))
        # Comparing takes longer than the size of a task's rows shows, so partitions are not to be merged.
        index, probes = index.repartition(parts, *key), probes.repartition(parts, *key)
        near = (F.col("a_class") != F.col("b_class")) & alike("a_chars", "b_chars") & (
            (F.col("a_chars") < F.col("b_chars")) | ((F.col("a_chars") == F.col("b_chars")) & (F.col("a") < F.col("b")))) & (
            ~F.arrays_overlap("a_before", "b_before")) & near
        for k in key:
            near = (index[k] == probes[k]) & near
        return index.join(probes, near).select("a", "b").distinct()

    # In marks of many lines only links come out of the join; elsewhere pairs do, at most CROWD for each entry.
    few = rows.filter("not crowded").withColumn("before", F.when(F.size("before") > NEXT, F.slice("before", -NEXT, NEXT)).otherwise(F.col("before")))
    few = alike_lines(met(few, ("mark",), F.lit(True)))
    texts = rows.filter("crowded").join(bodies.select("line_key", "line", "counts"), "line_key")
    apart = F.call_function("levenshtein", F.col("a_line"), F.col("b_line"), allowed(F.col("a_chars")))
    many = stored(met(texts, ("mark", "step", "salt"), can_be_near("a", "b") & (apart >= 0), "line", "counts"), "crowd-links")
    return links.unionByName(compared(few.union(many).distinct()))


def line_links(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text",
               by_length: bool = False, long_pairs: Callable[..., DataFrame] = long_links) -> DataFrame:
    """Pairs (a, b) of keys of different lines within ``edits`` edits, each pair once, with their distance.

    With ``by_length``, pairs whose shorter line is long are those of ``long_pairs``.
    """
    if not 0 < edits < min(min_chars, 15):
        raise ValueError("edits must be positive, less than min_chars and at most 14 (a band's word is an int)")
    parts, places = edits + 1, probe_places(edits)
    sized = lambda df: F.broadcast(df) if df.count() <= BROADCAST_KEYS else df
    lines = lines_of(docs, min_chars, doc_id, text)
    measured = lines.withColumn("chars", F.length("line"))
    keys = [probe_key(F.col("line"), F.col("chars"), *p, parts) for p in places]
    if by_length:
        keys = [F.when(~(F.col("chars") - d).between(LONG_FROM, LONG_TO - 1), key) for key, (d, _, _) in zip(keys, places)]
    keys = [key.alias(f"k{i}") for i, key in enumerate(keys)]
    distinct = measured.select("line_key", *keys).groupBy("line_key").agg(*[F.first(f"k{i}").alias(f"k{i}") for i in range(len(places))])
    distinct = stored(distinct.select("line_key", F.array(*[f"k{i}" for i in range(len(places))]).alias("keys")), "line-segments")
    own = {i: n for n, (d, i, shift) in enumerate(places) if d == 0 and shift == 0}  # place of each segment's own key
    entries = distinct.select("line_key", F.posexplode("keys").alias("place", "key")).filter("key is not null")
    live = stored(entries.groupBy("key").agg(
        F.min("line_key").alias("low"), F.max("line_key").alias("high"), F.max(F.col("place").isin(list(own.values()))).alias("indexed"),
        F.count("*").alias("n")).filter("indexed and low < high").select("key", F.ceil(F.col("n") / SPLIT).cast("int").alias("salts")),
        "live-keys")
    open_entries = stored(entries.join(sized(live), "key"), "open-entries")
    wanted = open_entries.select("line_key").distinct()
    texts = stored(lines.join(sized(wanted), "line_key", "left_semi").groupBy("line_key").agg(F.first("line").alias("line")), "line-texts")
    rows = open_entries.join(distinct.join(texts, "line_key"), "line_key")
    # Probes of a key that many lines have are dealt over several tasks, and its index rows go to each of them.
    index = rows.filter(F.col("place").isin(list(own.values()))).select(
        "key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("line_key").alias("a"),
        F.col("line").alias("shorter"), F.col("keys").alias("a_keys"))
    probes = rows.select("key", F.pmod("line_key", "salts").cast("int").alias("salt"), F.col("line_key").alias("b"), "place",
                         F.col("line").alias("longer"), F.col("keys").alias("b_keys"))
    even = F.col("place").isin([n for n, (d, _, _) in enumerate(places) if d == 0])
    met = F.lit(False)  # whether the pair meets at an earlier place too, where it was counted
    for n, (_, i, _) in enumerate(places):
        met = met | ((F.col("place") > n) & F.coalesce(F.get("a_keys", F.lit(own[i])) == F.get("b_keys", F.lit(n)), F.lit(False)))
    near = (F.col("a") != F.col("b")) & (~even | (F.col("a") < F.col("b"))) & ~met & (
        banded_distance(F.col("longer"), F.col("shorter"), edits) <= edits)
    pairs = index.join(probes, (index["key"] == probes["key"]) & (index["salt"] == probes["salt"]) & near)
    links = stored(pairs.select("a", "b", banded_distance(F.col("longer"), F.col("shorter"), edits).alias("distance")), "line-links")
    return links.unionByName(long_pairs(docs, doc_id, text)) if by_length else links


def judge_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text",
                by_length: bool = False) -> DataFrame:
    """One row per line of at least ``min_chars``: its class's first line, its number of linked lines, whether it goes.

    With ``by_length`` shorter lines with a letter or digit have a row too, and of long lines those links are counted that
    make the classes, not all pairs inside a class.
    """
    links = line_links(docs, edits, min_chars, doc_id, text, by_length, long_class_links)
    labels = components(links)
    degrees = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    linked = labels.join(degrees, "node").select(F.col("node").alias("line_key"), "label", "n_links")
    lines = lines_of(docs, 1 if by_length else min_chars, doc_id, text).filter(
        (F.length("line") >= min_chars) | F.col("line").rlike(r"[\p{L}\p{N}]"))
    lines = lines.drop("line").join(linked, "line_key", "left")
    lines = stored(lines.select(
        "doc_id", "text_key", "line_no", F.coalesce("label", "line_key").alias("class"),
        F.coalesce("n_links", F.lit(0)).alias("n_links")), "line-classes")
    place = F.struct("doc_id", "text_key", "line_no")
    # Only classes of two lines or more need the join.
    firsts = lines.groupBy("class").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    found = lines.join(firsts, "class", "left")
    first = F.coalesce("first", place)
    return found.select(
        "doc_id", "text_key", "line_no", first["doc_id"].alias("class_doc"), first["line_no"].alias("class_line"), "n_links",
        (~first.eqNullSafe(place)).alias("removed"))


def remove_lines(docs: DataFrame, verdicts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the removed lines; a document that loses its last word goes, all others and all columns stay."""
    gone = verdicts.filter("removed").groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("v_nos")).toDF(
        "v_id", "v_key", "v_nos")
    body = F.col(f"d.`{text}`")
    rest = F.array_join(F.filter(F.split(body, "\n", -1), lambda _, i: ~F.array_contains(F.col("v.v_nos"), i)), "\n")
    joined = docs.alias("d").join(
        gone.alias("v"), F.col(f"d.`{doc_id}`").eqNullSafe(F.col("v.v_id")) & (F.xxhash64(body) == F.col("v.v_key")), "left")
    return joined.filter(F.col("v.v_key").isNull() | rest.rlike(r"[^\x20\x09-\x0D]")).select(*[
        F.when(F.col("v.v_key").isNull(), body).otherwise(rest).alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns])
