"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays that workers map.

Counting: tasks turn texts into word hashes and send their distinct (word, next word) pairs with counts, packed by
bucket. The bucket of a pair comes from its first word and four bits of the second, so a word that starts a third of
all pairs is spread over sixteen buckets. A task that gets a bucket sorts it once and writes two sorted arrays of pair
hashes: pairs seen once, and pairs seen more often with their counts. It also returns, per first word and per second
word, sums of a few numbers, which Spark adds up into the context and continuation tables. These go into sorted arrays
too, one set per word bucket. The number of buckets follows the size of the training texts.

Scoring: a task maps the arrays and looks up the sorted distinct pairs of a chunk of texts bucket by bucket. Pages are
read as they are needed and shared by the workers of a machine.

The folder for the arrays is a new one in spark.checkpoint.dir, which all executors see. ``order`` is two: with three the
distinct trigrams alone would pass the disk budget of the check several times (see README).

Probability of word v after u, with c the training count and D1, D2, D3 the discounts of counts 1, 2, 3 and more:
p(v|u) = (c(u,v) - D) / c(u) + g(u) * p(v), g(u) = (D1 n1(u) + D2 n2(u) + D3 n3(u)) / c(u);
p(v) = (k(v) - D') / K + g * 1 / (V + 1), k(v) the number of distinct words before v, K their sum, V the words with k > 0,
and one more word for all unknown ones. A word u without training pairs takes p(v) alone. Discounts are the usual
estimates from counts of counts; one that cannot be estimated becomes the plain n1 / (n1 + 2 n2), or 0.5.

Defined cases: a null text is empty and has the end token only; a null id is scored and belongs to the training rows
unless ``held_out`` says so; rows that are repeated count as often as they occur; without training rows every token
has probability 1 (one unknown word); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropline.llm.common import array_uri, map_array, mixed, put_array, scratch_dir, stored, text_chunks, word_hashes

#: Characters of training text per bucket of pairs: about 25 MB of pairs in a task.
CHARS_PER_BUCKET = 10_000_000
#: Distinct pairs that a counting task holds before it sends them.
HELD_PAIRS = 1_500_000
START = np.uint64(0x0123456789ABCDEF)
END = np.uint64(0xFEDCBA9876543210)

PAIR_SCHEMA = "bucket int, pairs binary"
#: side 1: the word is first in pairs (total, n1, n2, n3); side 2: it is second (total is the token count, n1 the number of
#: distinct words before it); side 0: word holds the pair count (1 to 4) whose number of pairs is in total.
STAT_SCHEMA = "side int, word long, total long, n1 long, n2 long, n3 long"


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(mixed(first) + second)


def bucket_of(first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
    spread = mixed(first + (mixed(second) >> np.uint64(60)))
    return ((spread >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def token_pairs(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second token of every pair, texts in order, each ending in END; and the tokens per text."""
    words, counts = word_hashes(texts, lower=True)
    ends = np.cumsum(counts + 1) - 1
    second = np.empty(len(words) + len(counts), dtype=np.uint64)
    is_end = np.zeros(len(second), dtype=bool)
    is_end[ends] = True
    second[is_end] = END
    second[~is_end] = words
    first = np.empty_like(second)
    first[1:] = second[:-1]
    first[np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)[: len(counts)]] = START
    return first, second, counts + 1


def summed(first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, sorted by (first, second), with added counts."""
    order = np.lexsort((second, first))
    first, second, counts = first[order], second[order], counts[order]
    new = np.ones(len(first), dtype=bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    starts = np.flatnonzero(new)
    return first[starts], second[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def packed(first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> bytes:
    """Pairs seen once, then the others with their counts."""
    once = counts == 1
    head = np.array([once.sum(), (~once).sum()], dtype=np.int64)
    return b"".join(x.tobytes() for x in (head, first[once], second[once], first[~once], second[~once], counts[~once].astype(np.uint32)))


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = np.frombuffer(blob, np.int64, 2).tolist()
    u = np.frombuffer(blob, np.uint64, 2 * n + 2 * m, 16)
    counts = np.frombuffer(blob, np.uint32, m, 16 + 16 * (n + m)).astype(np.int64)
    return (np.concatenate([u[:n], u[2 * n:2 * n + m]]), np.concatenate([u[n:2 * n], u[2 * n + m:]]),
            np.concatenate([np.ones(n, np.int64), counts]))


def counter(buckets: int):
    def send(held: list) -> Iterator[pa.RecordBatch]:
        first, second, counts = summed(*[np.concatenate(x) for x in zip(*held)])
        bucket = bucket_of(first, second, buckets)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            part = order[bounds[b]:bounds[b + 1]]
            if len(part):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "pairs": pa.array(
                    [packed(first[part], second[part], counts[part])], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in text_chunks(batches):
            first, second, _ = token_pairs(batch.column("text").cast(pa.binary()).to_pylist())
            held.append(summed(first, second, np.ones(len(first), dtype=np.int64)))
            size += len(held[-1][0])
            if size > HELD_PAIRS:
                yield from send(held)
                held, size = [], 0
        if held:
            yield from send(held)

    return run


def bucket_writer(folder: str):
    """Sort each bucket of the task, write its arrays, return what it adds to the word tables."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list] = {}
        for batch in batches:
            for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("pairs").to_pylist()):
                blobs.setdefault(b, []).append(blob)
        for b in sorted(blobs):
            first, second, counts = summed(*[np.concatenate(x) for x in zip(*map(unpacked, blobs.pop(b)))])
            keys = pair_hash(first, second)
            order = np.argsort(keys)
            keys, sorted_counts = keys[order], counts[order]
            once = sorted_counts == 1
            put_array(f"{folder}/pairs-once-{b}.npy", keys[once])
            put_array(f"{folder}/pairs-more-{b}.npy", keys[~once])
            put_array(f"{folder}/pairs-count-{b}.npy", sorted_counts[~once].astype(np.uint32))
            starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            ones = [np.add.reduceat(x, starts) for x in (counts, (counts == 1) * 1, (counts == 2) * 1, (counts > 2) * 1)]
            after, codes = np.unique(second, return_inverse=True)
            tokens = np.bincount(codes, weights=counts).astype(np.int64)
            before = np.bincount(codes)
            level = np.bincount(np.minimum(counts, 5), minlength=6)[1:5]
            zeros = np.zeros(len(after), dtype=np.int64)
            for side, word, *rest in ((1, first[starts], *ones), (2, after, tokens, before, zeros, zeros),
                                      (0, np.arange(1, 5, dtype=np.uint64), level, *[np.zeros(4, np.int64)] * 3)):
                names = ("total", "n1", "n2", "n3")
                yield pa.RecordBatch.from_pydict(
                    {"side": pa.array(np.full(len(word), side), pa.int32()), "word": pa.array(word.view(np.int64))}
                    | {n: pa.array(np.asarray(x, dtype=np.int64)) for n, x in zip(names, rest)})

    return run


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3 from the numbers of entries with count 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 > 0 else 0.5
    y = y if 0 < y < 1 else 0.5
    found = [k - (k + 1) * y * b / a if a > 0 else y for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [d if 0 < d <= k else y for k, d in zip((1, 2, 3), found)]


def table_writer(folder: str, buckets: int, d: list[float], e: list[float], total: int, words: int):
    """Write the word tables: context total and weight, unigram probability, token count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = [b.to_pandas() for b in batches]
        frame = pd.concat(frames) if frames else pd.DataFrame(columns=["bucket"])
        for b, part in frame.groupby("bucket"):
            part = part.assign(u=part["word"].to_numpy().view(np.uint64)).sort_values("u")
            k = part["before"].to_numpy()
            cut = np.where(k > 2, e[2], np.where(k == 2, e[1], np.where(k == 1, e[0], 0.0)))
            left = part["total"].to_numpy()
            weight = (d[0] * part["n1"] + d[1] * part["n2"] + d[2] * part["n3"]).to_numpy() / np.maximum(left, 1)
            put_array(f"{folder}/words-{b}.npy", part["u"].to_numpy())
            put_array(f"{folder}/word-values-{b}.npy", np.column_stack(
                [left, weight, (k - cut) / max(total, 1), part["tokens"].to_numpy()]).astype(np.float64))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(b)], pa.int32()), "rows": pa.array([len(part)], pa.int64())})

    return run


def fit(docs: DataFrame, trains: Column, doc_id: str = "doc_id", text: str = "text") -> dict:
    """Count the rows for which ``trains`` holds; returns the folder of the arrays and the few numbers a scorer needs."""
    spark = docs.sparkSession
    folder = array_uri(scratch_dir(spark, "bigrams"))
    rows = docs.filter(trains).select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(chars / CHARS_PER_BUCKET))
    parts = max(buckets, 1)
    stats = rows.mapInArrow(counter(buckets), PAIR_SCHEMA).repartitionById(parts, F.col("bucket")).mapInArrow(
        bucket_writer(folder), STAT_SCHEMA)
    counted = stored(stats.groupBy((F.col("side") == 0).alias("level"), "word").agg(
        F.sum(F.when(F.col("side") == 0, F.col("total")).otherwise(0)).alias("pairs"),
        *[F.sum(F.when(F.col("side") == 1, F.col(c)).otherwise(0)).alias(c) for c in ("total", "n1", "n2", "n3")],
        F.sum(F.when(F.col("side") == 2, F.col("n1")).otherwise(0)).alias("before"),
        F.sum(F.when(F.col("side") == 2, F.col("total")).otherwise(0)).alias("tokens")), "bigram-words")
    by_word = counted.filter("not level").drop("level", "pairs")
    pair_levels = {int(r["word"]): r["pairs"] for r in counted.filter("level").collect()}  # four rows at most
    s = by_word.filter("before > 0").agg(
        F.count("*").alias("words"), F.coalesce(F.sum("before"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        *[F.count_if(F.col("before") == i).alias(f"k{i}") for i in (1, 2, 3, 4)],
        F.count_if(F.col("before") >= 3).alias("k3up")).first()
    d = discounts([pair_levels.get(i, 0) for i in (1, 2, 3, 4)])
    e = discounts([s["k1"], s["k2"], s["k3"], s["k4"]])
    held_back = (e[0] * s["k1"] + e[1] * s["k2"] + e[2] * s["k3up"]) / s["total"] if s["total"] else 1.0
    bucketed = by_word.withColumn("bucket", F.pmod(F.shiftrightunsigned("word", 20), F.lit(buckets)).cast("int"))
    written = bucketed.repartitionById(parts, F.col("bucket")).mapInArrow(
        table_writer(folder, buckets, d, e, int(s["total"]), int(s["words"])), "bucket int, rows long")
    stored(written, "bigram-tables")
    return {"folder": folder, "buckets": buckets, "discounts": d, "vocabulary": int(s["words"]), "train_tokens": int(s["tokens"]),
            "uniform": held_back / (s["words"] + 1)}


class Tables:
    """The mapped arrays of one model; lookups take sorted distinct values."""

    def __init__(self, model: dict):
        self.model, self.open = model, {}

    def array(self, name: str) -> np.ndarray | None:
        if name not in self.open:
            try:
                self.open[name] = map_array(f"{self.model['folder']}/{name}.npy")
            except FileNotFoundError:  # no pair or word fell into this bucket
                self.open[name] = None
        return self.open[name]

    def found(self, name: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table = self.array(name)
        if table is None or not len(table):
            return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.asarray(table[at]) == keys, at

    def words(self, words: np.ndarray) -> np.ndarray:
        """Context total, weight, unigram part, token count of each word; zeros for unknown ones."""
        out = np.zeros((len(words), 4))
        bucket = ((words >> np.uint64(20)) % np.uint64(self.model["buckets"])).astype(np.int64)
        for b in np.unique(bucket).tolist():
            rows = np.flatnonzero(bucket == b)
            hit, at = self.found(f"words-{b}", words[rows])
            if hit.any():
                out[rows[hit]] = self.array(f"word-values-{b}")[at[hit]]
        return out

    def pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        keys, bucket = pair_hash(first, second), bucket_of(first, second, self.model["buckets"])
        order = np.lexsort((keys, bucket))
        bounds = np.searchsorted(bucket[order], np.arange(self.model["buckets"] + 1))
        counts = np.zeros(len(keys), dtype=np.int64)
        for b in range(self.model["buckets"]):
            rows = order[bounds[b]:bounds[b + 1]]
            if len(rows):
                hit, _ = self.found(f"pairs-once-{b}", keys[rows])
                counts[rows[hit]] = 1
                hit, at = self.found(f"pairs-more-{b}", keys[rows])
                if hit.any():
                    counts[rows[hit]] = self.array(f"pairs-count-{b}")[at[hit]]
        return counts


def scorer(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(model)
        d = np.array([0.0, *model["discounts"]])
        for batch in text_chunks(batches):
            first, second, counts = token_pairs([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            words, codes = np.unique(np.concatenate([first, second]), return_inverse=True)
            values = tables.words(words)
            u, v = values[codes[:len(first)]], values[codes[len(first):]]
            pair = tables.pairs(first, second)
            lower = v[:, 2] + model["uniform"]
            seen = u[:, 0] > 0
            upper = np.where(seen, (pair - d[np.minimum(pair, 3)]) / np.maximum(u[:, 0], 1), 0.0)
            logs = np.log10(upper + np.where(seen, u[:, 1], 1.0) * lower)
            base = np.log10((v[:, 3] + 1) / (model["train_tokens"] + model["vocabulary"] + 1))
            starts = np.cumsum(counts) - counts
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts), pa.array(np.add.reduceat((v[:, 3] > 0).astype(np.int64), starts)),
                 pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(logs, starts))],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, perplexity); base_score is the add-one unigram score."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scored = rows.mapInArrow(scorer(model), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
