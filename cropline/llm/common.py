"""Helpers shared by the operators of this folder: scratch tables, row keys, word hashes, connected components.

Inputs are copied into frames with fixed internal names first, so extra columns of a caller never clash. A row is known
by (doc_id, hash of its text), compared null-safely: two rows with the same id and text are one document.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task turns into words at once.
CHUNK_BYTES = 2_000_000
#: Edges (each from both ends) that one task goes through in a round; more of them are dealt out by their nodes.
ONE_TASK = 200_000


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder that the session names in spark.checkpoint.dir.

    Where the setting is missing, a local session takes a temporary folder; a cluster must name a shared one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cropline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(doc_id: str, text: str) -> list[Column]:
    return [F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key")]


def documents_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **others: str) -> DataFrame:
    """doc_id, text_key, text and the columns named in ``others`` (new name = column), nothing else."""
    return docs.select(
        *row_key(doc_id, text), F.col(text).cast("string").alias("text"),
        *[F.col(c).alias(n) for n, c in others.items()],
    )


def unused_name(df: DataFrame, base: str) -> str:
    name = base
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def keep_rows(docs: DataFrame, dropped: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, whose (doc_id, text_key) is not in ``dropped``."""
    gone = dropped.select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
    a, b = unused_name(docs, "_row_id"), unused_name(docs, "_row_key")
    marked = docs.withColumns({a: F.col(doc_id), b: F.xxhash64(F.col(text))})
    gone = gone.toDF(a + "g", b + "g")
    return marked.join(gone, F.col(a).eqNullSafe(F.col(a + "g")) & (F.col(b) == F.col(b + "g")), "left_anti").select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )


# --- Python side -------------------------------------------------------------------------------------------------


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about CHUNK_BYTES of text, at least one row each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and total + size > CHUNK_BYTES:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if len(sizes) > start:
            yield batch.slice(start)


def word_hashes(texts: list[bytes | None], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the number of words of each text.

    Words are maximal runs without space, tab, LF, VT, FF or CR, which are the bytes that bytes.split() parts at;
    bytes.lower() changes A-Z only.
    """
    lists = [(t.lower() if lower else t).split() if t else [] for t in texts]
    counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    words = np.empty(int(counts.sum()), dtype=object)
    at = 0
    for x in lists:
        words[at:at + len(x)] = x
        at += len(x)
    return hash_words(words), counts


def hash_words(words: np.ndarray) -> np.ndarray:
    """Stable 64-bit hashes of byte strings."""
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    codes, distinct = pd.factorize(words)
    return pd.util.hash_array(distinct, categorize=False)[codes]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each window of ``size`` words, over the whole array; callers leave out windows across texts."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[i:i + n])
    return out


def block_and_key(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The block (top bits) of each hash and the 32 bits after it."""
    block = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), dtype=np.int64)
    return block, ((hashes << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


# --- files that workers map into memory ----------------------------------------------------------------------------


def put_array(uri: str, array: np.ndarray) -> None:
    """Write one array file under a name of its own and move it into place.

    Not every store lets a move replace a file. A repeated attempt writes the same rows, so it leaves a file that is there.
    """
    import io

    from pyarrow import fs as pafs

    store, path = pafs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    buffer = io.BytesIO()
    np.save(buffer, array)
    attempt = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(attempt) as out:
        out.write(buffer.getbuffer())
    there = lambda: store.get_file_info(path).type == pafs.FileType.File
    if not there():
        try:
            store.move(attempt, path)
            return
        except OSError:
            if not there():  # or another attempt was first
                raise
    store.delete_file(attempt)


def map_array(uri: str) -> np.ndarray:
    """Map an array file; from a store without local paths it is fetched once into the worker's own cache."""
    from pyarrow import fs as pafs

    store, path = pafs.FileSystem.from_uri(uri)
    if not isinstance(store, pafs.LocalFileSystem):
        cached = os.path.join(tempfile.gettempdir(), f"{uuid.uuid5(uuid.NAMESPACE_URL, uri).hex}.npy")
        if not os.path.exists(cached):
            own = f"{cached}.{uuid.uuid4().hex}"
            with store.open_input_stream(path) as src, open(own, "wb") as out:
                while block := src.read(1 << 20):
                    out.write(block)
            os.replace(own, cached)
        path = cached
    return np.load(path, mmap_mode="r")


def array_uri(folder: str) -> str:
    return folder if "://" in folder else "file://" + folder.removeprefix("file:")


# --- connected components ------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of ``edges`` (a, b); label is the smallest node of the component.

    Rounds of neighbour minima followed by pointer jumping, each written to the shared folder. Both joins meet labels
    that are unique by node, so a hub only makes one side large, which adaptive execution splits. Rounds over few edges
    take one task each.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    both = stored(both.distinct(), "edges")
    gathered = (lambda df: df.coalesce(1)) if both.count() <= ONE_TASK else (lambda df: df)
    both = gathered(both)
    labels = gathered(stored(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.col("a")).alias("label")), "labels"))
    while True:  # labels only fall, so this ends
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(
            F.min("label").alias("near"))
        near = labels.join(seen.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jumped"))
        moved = gathered(stored(near.join(jump, "label", "left").select(
            "node", F.least("label", F.coalesce("jumped", "label")).alias("label"),
            (F.least("label", F.coalesce("jumped", "label")) < F.col("old")).alias("changed")), "labels"))
        labels = moved.select("node", "label")
        if moved.filter("changed").isEmpty():
            return labels
