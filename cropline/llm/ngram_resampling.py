"""Target-distribution importance resampling: documents drawn by how much their n-grams look like those of target texts.

* **Features.** A-Z are lower-cased; words are runs of letters, digits and code points from U+0080 on; the features of a text
  are all runs of 1 to ``LONGEST`` consecutive words, joined by one space, repeats counted.
* **Table.** The features of one batch are interned in an open-addressed table of NumPy arrays: the key is the XXH64 of a
  feature's bytes, its home the key's low bits; whoever is not at home moves one slot on. All features move together: those at
  an empty slot claim it (one of them wins), those at a slot of equal key and equal bytes have found theirs, the others go on.
  Bytes are compared eight at a time, so two features of equal hash never share a slot. A slot has the feature's bucket,
  crc32 of its bytes modulo ``buckets`` worked out once per slot, and its count. Each occurrence keeps its slot's number.
* **Counts.** Each task adds up bucket counts of its batches; Spark adds those up. There are ``buckets`` sums of the documents
  and as many of the target texts, whatever the input's size; their logarithmic ratios are the gains.
* **Weights.** A second pass interns each batch again; the slot ids of the occurrences gather the gains of their slots'
  buckets, which are summed by document.
* **Draw.** weight + Gumbel noise from a hash of the id; the highest scores among documents of enough words are drawn, which
  is a draw without replacement by the weights. Ranks are places in a global order that is dealt over ranges of the scores
  and numbered from the sizes of the ranges, so no task sees all scores.

Defined cases: a null or wordless text has no feature, weight 0, and is not drawn; a null id counts as an empty text in the
noise and ties after all ids; rows of equal id and score have ranks of their own; no target texts or an empty table give
gains of equal counts, or no rows. A very long text is a batch of its own. Other columns are not looked at, so their names
never clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropline.llm.common import scratch_dir, stored, text_chunks
from cropline.operators.relational import row_index

BUCKETS, LONGEST, SEED, MIN_WORDS, PERCENT = 10_000, 3, 42, 20, 5
SEPARATOR = 10
#: Bytes to the byte that stands for them: A-Z to a-z, what is in no word to a space.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


class Occurrences:
    """The features of some texts as places of one buffer; a text's features have its number as ``owner``."""

    def __init__(self, texts: list[bytes | None], longest: int = LONGEST):
        words = [t.translate(FOLDED).split() if t else [] for t in texts]
        self.n_words = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.buffer = b"\n".join(b" ".join(w) for w in words if w) + b"\n"
        data = np.frombuffer(self.buffer, np.uint8)
        ends = np.flatnonzero((data == 32) | (data == SEPARATOR))
        starts = np.concatenate([[0], ends[:-1] + 1])
        of_word = np.repeat(np.arange(len(words)), self.n_words)
        total = len(of_word)
        starts, ends = starts[:total], ends[:total]  # without any word there is one empty part
        parts = []
        for n in range(1, longest + 1):
            k = max(0, total - n + 1)
            inside = of_word[:k] == of_word[n - 1:] if k else np.empty(0, dtype=bool)
            parts.append((starts[:k][inside], ends[n - 1:][inside], of_word[:k][inside]))
        self.starts, self.ends, self.owner = (np.concatenate(x) for x in zip(*parts))


def eights(buffer: bytes) -> np.ndarray:
    """The eight bytes from each place of ``buffer`` as one number; past the end there are zeros."""
    padded = np.frombuffer(buffer + bytes(8), np.uint8)
    return np.ndarray((len(buffer) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def same_bytes(at: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from a[i] and from b[i] are equal."""
    equal = np.ones(len(a), dtype=bool)
    left, done = np.arange(len(a)), 0
    while len(left):
        rest = size[left] - done
        shift = np.where(rest >= 8, 0, 8 * (8 - rest)).astype(np.uint64)
        equal[left] = ((at[a[left] + done] ^ at[b[left] + done]) << shift) == 0
        done += 8
        left = left[(rest > 8) & equal[left]]
    return equal


def rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(buffer: bytes, at: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH64 with seed 0 of many byte ranges of ``buffer``: those under 32 bytes together, longer ones by the library."""
    # The fixed primes of XXH64.
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    order = np.argsort(np.minimum(sizes, 32).astype(np.uint8), kind="stable")[::-1]  # longest first: who still has bytes is a prefix
    size = sizes[order]
    n_long = int((size >= 32).sum())
    start, size = starts[order[n_long:]], size[n_long:]
    h = p5 + size.astype(np.uint64)
    done = np.zeros(len(size), dtype=np.int64)
    for lane in range(3):
        k = int((size >= 8 * lane + 8).sum())
        h[:k] = rotated(h[:k] ^ (rotated(at[start[:k] + 8 * lane] * p2, 31) * p1), 27) * p1 + p4
        done[:k] += 8
    four = np.flatnonzero(size - done >= 4)
    word = at[start[four] + done[four]] & np.uint64(0xFFFFFFFF)
    h[four] = rotated(h[four] ^ (word * p1), 23) * p2 + p3
    done[four] += 4
    for _ in range(3):
        one = np.flatnonzero(done < size)
        byte = at[start[one] + done[one]] & np.uint64(255)
        h[one] = rotated(h[one] ^ (byte * p5), 11) * p1
        done[one] += 1
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    out = np.empty(len(sizes), dtype=np.uint64)
    out[order[n_long:]] = h ^ (h >> np.uint64(32))
    for i in order[:n_long].tolist():
        out[i] = xxhash.xxh64_intdigest(buffer[starts[i]:starts[i] + sizes[i]])
    return out


def crc_table() -> np.ndarray:
    """What each byte does to a CRC-32 (reflected polynomial EDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


CRC = crc_table()


def crc32(buffer: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of many byte ranges, one byte of all of them after the other; the few very long ones by the library."""
    out = np.empty(len(starts), dtype=np.uint32)
    far = sizes > 255
    for i in np.flatnonzero(far).tolist():
        out[i] = zlib.crc32(buffer[starts[i]:starts[i] + sizes[i]])
    rest = np.flatnonzero(~far)
    order = rest[np.argsort(sizes[rest].astype(np.uint8), kind="stable")[::-1]]
    data, start = np.frombuffer(buffer, np.uint8), starts[order]
    more = np.searchsorted(-sizes[order], -np.arange(int(sizes[order[0]]) if len(order) else 0))  # ranges longer than j
    state = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for j, k in enumerate(more.tolist()):
        s = state[:k]
        state[:k] = CRC[(s & np.uint32(255)) ^ data[start[:k] + j]] ^ (s >> np.uint32(8))
    out[order] = ~state
    return out


class InternTable:
    """Open addressing over NumPy arrays for the features of one batch."""

    def __init__(self, found: Occurrences, buckets: int = BUCKETS):
        n = len(found.starts)
        self.size = 1 << max(4, int(2 * n - 1).bit_length() if n else 0)  # at most half full
        self.first = np.full(self.size, -1, dtype=np.int64)  # the occurrence that a slot was claimed by
        self.slot = np.empty(n, dtype=np.int64)
        self._intern(found)
        self.used = np.flatnonzero(self.first >= 0)
        self.count = np.bincount(self.slot, minlength=self.size)
        owner = self.first[self.used]
        self.bucket = np.zeros(self.size, dtype=np.int64)
        self.bucket[self.used] = crc32(found.buffer, found.starts[owner], (found.ends - found.starts)[owner]) % np.uint32(buckets)

    def _intern(self, found: Occurrences) -> None:
        mask = np.int64(self.size - 1)
        at, sizes = eights(found.buffer), found.ends - found.starts
        keys = xxh64(found.buffer, at, found.starts, sizes)
        going, place = np.arange(len(keys)), (keys & np.uint64(mask)).astype(np.int64)
        while len(going):
            here = self.first[place]
            free = here < 0
            if free.any():
                self.first[place[free]] = going[free]  # of several at one slot the last one stays
                here = self.first[place]
            match = (keys[here] == keys[going]) & (sizes[here] == sizes[going])
            check = np.flatnonzero(match & (here != going))
            match[check] = same_bytes(at, found.starts[here[check]], found.starts[going[check]], sizes[going[check]])
            self.slot[going[match]] = place[match]
            going, place = going[~match], (place[~match] + 1) & mask

    def bucket_counts(self, buckets: int) -> np.ndarray:
        return np.bincount(self.bucket[self.used], weights=self.count[self.used], minlength=buckets).astype(np.int64)


def counter(longest: int, buckets: int):
    """The bucket counts of a task, one row per bucket that it has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in text_chunks(batches):
            found = Occurrences(batch.column("text").cast(pa.binary()).to_pylist(), longest)
            total += InternTable(found, buckets).bucket_counts(buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return run


def weigher(gains: np.ndarray, longest: int):
    """n_words, n_features and weight of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            found = Occurrences(batch.column("text").cast(pa.binary()).to_pylist(), longest)
            table = InternTable(found, len(gains))
            gathered = gains[table.bucket][table.slot]
            n = batch.num_rows
            # Whole numbers far below 2**53, so sums of doubles are exact.
            weight = np.bincount(found.owner, weights=gathered, minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found.n_words), pa.array(np.bincount(found.owner, minlength=n).astype(np.int64)), pa.array(weight)],
                ["doc_id", "n_words", "n_features", "weight"])

    return run


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences by bucket; ``buckets`` numbers come to the driver."""
    parts = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(counter(longest, buckets), "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The thousandths of the log ratio of smoothed shares, by bucket, rounded down."""
    n, s, t = len(source), source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST,
             buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank (null where it is not drawn)."""
    gains = gains_of(bucket_counts(docs, text, longest, buckets), bucket_counts(target, text, longest, buckets))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    weighed = rows.mapInArrow(weigher(gains, longest), f"doc_id {kind}, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(weighed.withColumn("score", F.col("weight") + noise), "resampling-scores")
    enough = F.col("n_words") >= min_words
    drawn = F.floor(F.lit(percent) * scored.filter(enough).count() / 100)
    ranked = row_index(scored.filter(enough), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "place",
                       scratch_dir(docs.sparkSession, "resampling-order"))
    rank = F.when(F.col("place") <= drawn, F.col("place")).alias("rank")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    return ranked.select(*columns, rank).unionByName(scored.filter(~enough).select(*columns, F.lit(None).cast("long").alias("rank")))


def drawn_documents(docs: DataFrame, resampled: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that were drawn."""
    ids = resampled.filter("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, docs[doc_id].eqNullSafe(ids["_drawn"]), "left_semi")
