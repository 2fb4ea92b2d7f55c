"""Quality rules: counts of a text by itself, and the frequency of its lines across the documents of a host.

One pass over the texts gives the counts and, for each line with a word, a 64-bit hash of its normalised form
(A-Z lower-cased, digits as 0, words joined by one space). Lines are counted by distinct documents of a host. A line
found in more than ``max_docs`` documents of its host is boilerplate and is removed; a document is rejected when less
than ``min_words`` words, or less than ``min_share`` of its words, would stay.

Defined cases: a null text has no words and no lines; a null host is a host of its own; rows with the same id, text and
host are one document when lines are counted, and each gets its row in the result; an empty table gives no rows.
Line numbers start at 0 and count all ``\\n``-separated lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropline.llm.common import documents_of, hash_words, stored, text_chunks, window_hashes, word_hashes

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
DIGITS_AS_ZERO = bytes.maketrans(b"123456789", b"000000000")
WINDOW = 5

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCHEMA = f"doc_id long, text_key long, host string, {COUNTS}, lines array<struct<no: int, line: long, words: int>>"


def repeated_words(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, the words that lie in a five-word window which the text has twice or more."""
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(words) < WINDOW:
        return np.zeros(len(counts), dtype=np.int64)
    inside = np.flatnonzero(owner[: len(words) - WINDOW + 1] == owner[WINDOW - 1:])
    keys = window_hashes(words, WINDOW)[inside]
    order = np.lexsort((keys, owner[inside]))
    keys, starts = keys[order], inside[order]
    same = (keys[1:] == keys[:-1]) & (owner[starts[1:]] == owner[starts[:-1]])
    twice = np.zeros(len(keys), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, starts[twice], 1)
    np.add.at(edges, starts[twice] + WINDOW, -1)
    return np.bincount(owner, weights=np.cumsum(edges[:-1]) > 0, minlength=len(counts)).astype(np.int64)


def count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches):
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        words, counts = word_hashes(texts, lower=False)
        chars, symbols, doubled, offsets, numbers, norms, widths = [], [], [], [0], [], [], []
        for t in texts:
            chars.append(len(t.decode("utf-8", "replace")) - sum(t.count(c) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")))
            symbols.append(len(t) - len(t.translate(None, SYMBOLS)))
            seen, lines = set(), 0
            for no, line in enumerate(t.split(b"\n")):
                parts = line.split()
                if parts:
                    lines += 1
                    seen.add(line)
                    numbers.append(no)
                    norms.append(b" ".join(parts).lower().translate(DIGITS_AS_ZERO))
                    widths.append(len(parts))
            doubled.append(lines - len(seen))
            offsets.append(len(norms))
        hashed = np.empty(len(norms), dtype=object)
        hashed[:] = norms
        lines = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(numbers, pa.int32()), pa.array(hash_words(hashed).view(np.int64)), pa.array(widths, pa.int32())],
            ["no", "line", "words"]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), batch.column("host"), pa.array(counts),
             pa.array(chars, pa.int64()), pa.array(symbols, pa.int64()), pa.array(doubled, pa.int64()),
             pa.array(repeated_words(words, counts)), lines],
            ["doc_id", "text_key", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])


def judge_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
    max_docs: int = 5, min_words: int = 10, min_share: float = 0.5, max_repeat_percent: int = 20,
) -> DataFrame:
    """One row per document: counts, ``base_failed``, removed lines and words, and ``kept``."""
    rows = documents_of(docs, doc_id, text, host=host).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text_key", F.col("host").cast("string").alias("host"), "text")
    counted = stored(rows.mapInArrow(count_texts, SCHEMA), "line-counts")
    key = ["doc_id", "text_key", "host"]
    once = counted.select(*key, F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    common = (once.groupBy(*key, "line").agg(F.lit(1).alias("one"))
              .groupBy("host", "line").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > max_docs)
              .select(F.col("host").alias("common_host"), F.col("line").alias("common_line")))
    lines = counted.dropDuplicates(key).select(*key, F.explode("lines").alias("x")).select(*key, "x.no", "x.line", "x.words")
    removed = lines.join(common, (F.col("line") == F.col("common_line")) & F.col("host").eqNullSafe(F.col("common_host"))
                         ).groupBy(*key).agg(F.sum("words").alias("gone"), F.collect_list("no").alias("nos"))
    removed = removed.toDF("r_id", "r_key", "r_host", "gone", "nos")
    joined = counted.drop("lines").join(
        removed, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_key") == F.col("r_key"))
        & F.col("host").eqNullSafe(F.col("r_host")), "left")
    gone = F.coalesce("gone", F.lit(0))
    left = F.col("n_words") - gone
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return joined.select(
        "doc_id", "text_key", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (left >= min_words) & (left >= min_share * F.col("n_words"))).alias("kept"),
        gone.alias("n_removed_words"), F.array_sort(F.coalesce("nos", F.array().cast("array<int>"))).alias("removed_lines"),
    )


def clean_texts(docs: DataFrame, verdicts: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The kept documents with their boilerplate lines taken out; all columns of ``docs`` stay."""
    kept = verdicts.filter("kept").select(
        F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_key"), F.col("host").alias("k_host"),
        F.col("removed_lines").alias("k_nos")).dropDuplicates(["k_id", "k_key", "k_host"])
    body = F.col(f"d.`{text}`")
    lines = F.filter(F.split(body, "\n", -1), lambda x, i: ~F.array_contains(F.col("k.k_nos"), i))
    return docs.alias("d").join(
        kept.alias("k"), F.col(f"d.`{doc_id}`").eqNullSafe(F.col("k.k_id"))
        & (F.xxhash64(body) == F.col("k.k_key")) & F.col(f"d.`{host}`").eqNullSafe(F.col("k.k_host"))
    ).select(*[F.array_join(lines, "\n").alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns])
