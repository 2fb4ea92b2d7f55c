"""Best-fit-decreasing packing into id matrices.

Each task turns its documents into ids a block at a time and packs each block by itself, so ids are never shuffled and
memory is bounded by the block. Documents longer than a row are split without loss into full rows and a rest. Whole
pieces of at most a row are placed in order of falling length into the open row with the least room that still holds
them; a segment tree over the room left (0 to ``length``) finds that row. The rows are written as Parquet: ``ids`` (little
endian, padded with ``pad_id``), ``cu_seqlens`` (0, then the end of each segment), ``position_resets`` (where positions
start again at 0, or go on at ``position_starts`` for the rest of a split document).

Defined cases: a null or empty text is the end id alone; repeated rows are packed as often as they occur; a null id stays
null; an empty table gives no rows. Which rows are packed together depends on how Spark splits the input, which for files
is the same at every attempt.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropline.llm.common import scratch_dir
from cropline.llm.packing import Pieces, token_blocks, tokenizer

ROWS = ("sequence_id long, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, "
        "position_starts array<long>, doc_ids array<long>, doc_tokens array<long>")
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "segment int, position_start long, padding long")


class RoomTree:
    """Counts of open rows by room left, in a segment tree: the least room of at least n takes log2(length) steps."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """Remove and return (room, row) with the least room of at least ``n``."""
        at = n + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, self.rows[room].pop()


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers; every piece is at most ``length``."""
    tree, rows = RoomTree(length), []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[piece])
        if found is None:
            found = length, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(piece)
        if room > lengths[piece]:
            tree.add(room - lengths[piece], row)
    return rows


def cut(arrays: list[np.ndarray], length: int) -> list[tuple[int, int, int]]:
    """(document, start, end) of pieces of at most ``length``: full ones and a rest."""
    return [(d, at, min(at + length, len(a))) for d, a in enumerate(arrays) for at in range(0, len(a), length)]


def packer(pieces: Pieces, length: int, pad_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for names, arrays in token_blocks(batches, pieces):
            parts = cut(arrays, length)
            rows = best_fit([e - s for _, s, e in parts], length)
            for first in range(0, len(rows), 500):
                out = {k.split()[0]: [] for k in ROWS.split(", ")}
                for row in rows[first:first + 500]:
                    ids = np.full(length, pad_id, dtype="<u2" if max(pad_id, 65535) == 65535 else "<u4")
                    ends = [0]
                    for p in row:
                        d, s, e = parts[p]
                        part = arrays[d][s:e]
                        if ids.itemsize == 2 and part.max() > 65535:
                            ids = ids.astype("<u4")
                        ids[ends[-1]:ends[-1] + e - s] = part
                        ends.append(ends[-1] + e - s)
                    for k, x in (("sequence_id", number), ("ids", ids.tobytes()), ("n_tokens", ends[-1]), ("cu_seqlens", ends),
                                 ("position_resets", ends[:-1]), ("position_starts", [parts[p][1] for p in row]),
                                 ("doc_ids", [names[parts[p][0]] for p in row]),
                                 ("doc_tokens", [len(arrays[parts[p][0]]) for p in row])):
                        out[k].append(x)
                    number += 1
                types = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))

    return run


def pack(docs: DataFrame, length: int = 2048, doc_id: str = "doc_id", text: str = "text", path: str | None = None,
         pieces: Pieces | None = None, pad_id: int = 0) -> DataFrame:
    """Write the packed rows to ``path`` (default: a new folder in the shared folder) and return them as read back."""
    path = path or scratch_dir(docs.sparkSession, "packed")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    packed = rows.mapInArrow(packer(pieces or tokenizer(), length, pad_id), ROWS)
    packed.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(ROWS).parquet(path)


def read_pieces(length: int):
    """The pieces found in packed rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], dtype="<u2" if len(row["ids"]) == 2 * length else "<u4").astype("<u4")
                cu = row["cu_seqlens"]
                for i, doc in enumerate(row["doc_ids"]):
                    a, b = cu[i], cu[i + 1]
                    out.append((doc, row["position_starts"][i], b - a, zlib.crc32(ids[a:b].tobytes()), row["doc_tokens"][i],
                                row["sequence_id"], a, i, row["position_starts"][i], length - row["n_tokens"]))
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if n == "segment" else pa.int64()) for n, c in zip(names, columns)], names)

    return run


def pieces_of(packed: DataFrame, length: int = 2048) -> DataFrame:
    """One row per piece, read back from packed rows."""
    return packed.mapInArrow(read_pieces(length), PIECES)
