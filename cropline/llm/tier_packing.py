"""Hierarchical packing: context-size tiers, gaps of longer windows filled from shorter tiers, balanced step groups.

A document goes to the smallest tier that holds it; a longer one than the last tier is cut into full windows of the last
tier and a rest, which is routed like a document. Tiers are packed from the longest down: whole pieces best-fit by
falling length, then each window's gap is filled from the longest pieces of the shorter tiers that fit, and what still
stays open is closed by cutting the longest waiting piece. So every window of a block is full but the very last, whose
tokens are cut into full shorter windows, and only less than the smallest tier is padded. A window of tier T has exactly
T tokens, a power of two; the padded one of each block is of the last tier.

Each task packs its own documents a block at a time (see ``packing``): no ids are shuffled and memory is bounded.
Step groups: windows of a tier are numbered over all tasks by adding up the tasks' counts, and a step of a tier takes
``step_tokens`` / T neighbouring numbers, so steps of all tiers have the same tokens.

Defined cases: as in ``best_fit_packing``.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cropline.llm.common import stored
from cropline.llm.packing import Pieces, token_blocks, tokenizer

TIERS = (256, 512, 1024, 2048)
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tier int, task int, tier_rank long, padding long")


class Waiting:
    """Pieces (document, start, end) of one tier in order of length."""

    def __init__(self):
        self.sizes: list[int] = []
        self.pieces: dict[int, list[tuple[int, int, int]]] = {}

    def add(self, piece: tuple[int, int, int]) -> None:
        size = piece[2] - piece[1]
        held = self.pieces.setdefault(size, [])
        if not held:
            insort(self.sizes, size)
        held.append(piece)

    def take(self, room: int) -> tuple[int, int, int] | None:
        """The longest piece that fits into ``room``."""
        at = bisect_right(self.sizes, room) - 1
        return self.pop(at) if at >= 0 else None

    def longest(self) -> tuple[int, int, int] | None:
        return self.pop(len(self.sizes) - 1) if self.sizes else None

    def pop(self, at: int) -> tuple[int, int, int]:
        size = self.sizes[at]
        piece = self.pieces[size].pop()
        if not self.pieces[size]:
            self.sizes.pop(at)
        return piece


def fill_windows(lengths: list[int], tiers: tuple[int, ...]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(tier, pieces) of all windows of a block; each token of each document is in exactly one piece."""
    waiting = [Waiting() for _ in tiers]

    def route(piece: tuple[int, int, int]) -> None:
        size = piece[2] - piece[1]
        waiting[next(i for i, t in enumerate(tiers) if size <= t)].add(piece)

    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    for d, n in enumerate(lengths):
        full = n - n % tiers[-1]
        windows += [(tiers[-1], [(d, s, s + tiers[-1])]) for s in range(0, full, tiers[-1])]
        if n > full:
            route((d, full, n))
    for level in range(len(tiers) - 1, -1, -1):
        size = tiers[level]
        while (piece := waiting[level].longest()) is not None:
            window, room = [piece], size - (piece[2] - piece[1])
            for below in range(level, -1, -1):  # its own tier first, then the shorter ones
                while room and (more := waiting[below].take(room)) is not None:
                    window.append(more)
                    room -= more[2] - more[1]
            if room:  # nothing waiting fits whole: cut the longest piece there is
                donor = next((p for below in range(level, -1, -1) if (p := waiting[below].longest()) is not None), None)
                if donor is not None:
                    window.append((donor[0], donor[1], donor[1] + room))
                    route((donor[0], donor[1] + room, donor[2]))
                    room = 0
            if not room:
                windows.append((size, window))
                continue
            # Nothing waits any more: cut what there is into the full shorter windows it gives.
            for tier in reversed(tiers[:level]):
                if sum(e - s for _, s, e in window) >= tier:
                    need, taken, rest = tier, [], []
                    for d, s, e in window:
                        here = min(need, e - s)
                        taken += [(d, s, s + here)] * (here > 0)
                        rest += [(d, s + here, e)] * (here < e - s)
                        need -= here
                    windows.append((tier, taken))
                    window = rest
            if window:
                windows.append((tiers[-1], window))
    return windows


def packer(pieces: Pieces, tiers: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number, ranks = task << 33, dict.fromkeys(tiers, 0)
        names = [x.split()[0] for x in PIECES.split(", ")]
        for docs, arrays in token_blocks(batches, pieces):
            out = []
            for tier, window in fill_windows([len(a) for a in arrays], tiers):
                at, total = 0, sum(e - s for _, s, e in window)
                pad = 0 if total & (total - 1) == 0 else tiers[-1] - total
                for d, s, e in window:
                    out.append((docs[d], s, e - s, zlib.crc32(arrays[d][s:e].tobytes()), len(arrays[d]), number, at,
                                tier, task, ranks[tier], pad))
                    at += e - s
                number += 1
                ranks[tier] += 1
            for i in range(0, len(out), 20_000):
                columns = zip(*out[i:i + 20_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if n in ("tier", "task") else pa.int64()) for n, c in zip(names, columns)], names)

    return run


def pack(docs: DataFrame, tiers: tuple[int, ...] = TIERS, step_tokens: int = 65536, doc_id: str = "doc_id",
         text: str = "text", pieces: Pieces | None = None) -> DataFrame:
    """One row per piece, with its window, tier and step group."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    packed = stored(rows.mapInArrow(packer(pieces or tokenizer(), tuple(sorted(tiers))), PIECES), "tier-pieces")
    # A row per task and tier; the running count of the tasks before makes ranks global.
    counts = packed.groupBy("task", "tier").agg((F.max("tier_rank") + 1).alias("n"))
    before = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("task", "tier", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    per_step = F.greatest(F.lit(1), F.floor(F.lit(step_tokens) / F.col("tier")))
    return packed.join(first, ["task", "tier"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "padding",
        F.floor((F.col("first") + F.col("tier_rank")) / per_step).cast("long").alias("step_group"))
