"""Benchmark decontamination: a broadcast hash set of benchmark n-grams probed by every token window of the corpus.

Words are maximal runs outside ASCII control characters, space, punctuation and symbols, digits and letters being word
characters and all non-ASCII characters too; A-Z are lower-cased. A window is ``size`` consecutive words of an item, or
all words of a shorter one. The scan hashes every window of every document and probes the hash set; hits are compared
as text before they count. All of it is DataFrame expressions.

Defined cases: null or empty texts have no words and no hits; a benchmark row without words has no window; a null
item id counts as the id "null"; items with one id are one item; rows with the same id and text are one document and
each gets its row in the result; empty tables give no rows, or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropline.llm.common import documents_of, keep_rows, stored

#: Any-case words; upper-case ASCII letters are lower-cased afterwards, only in the words that have some.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of the hash set, or ids of suspects, that may be broadcast (two longs and a short text each); more are joined by
#: shuffle.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    return F.transform(raw, lambda w: F.when(w.rlike("[A-Z]"), F.translate(w, UPPER, LOWER)).otherwise(w))


def windows_of(hashes: Column, n: Column, length: int) -> Column:
    """The hash of each window of ``length`` words, in order."""
    return F.when(n >= length, F.transform(
        F.sequence(F.lit(1), n - (length - 1)), lambda i: F.xxhash64(F.lit(length), F.slice(hashes, i, length)))
    ).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = 13) -> DataFrame:
    """(gram, gram_text, length, item_id) of all distinct windows of all items."""
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item_id"), words_of(F.col(text)).alias("words")
    ).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(size))
    texts = F.transform(F.sequence(F.lit(1), F.size("words") - length + 1), lambda i: F.slice("words", i, length))
    return items.select("item_id", length.alias("length"), F.explode(texts).alias("w")).select(
        F.xxhash64(F.col("length"), F.transform("w", lambda x: F.xxhash64(x))).alias("gram"),
        F.array_join("w", " ").alias("gram_text"), "length", "item_id").distinct()


def judge_documents(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", size: int = 13, min_percent: int = 5,
) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, items (sorted ids), spans, contaminated.

    ``spans`` holds (first word, number of words) of the hits, from 1, by first word.
    """
    grams = stored(benchmark_windows(benchmark, item_id, item_text, size), "benchmark-windows")
    lengths = sorted(r[0] for r in grams.select("length").distinct().collect())  # at most ``size`` values
    hash_set = grams.select("gram", "length").distinct()
    small = grams.count() <= BROADCAST_ROWS
    sized = F.broadcast if small else (lambda df: df)

    corpus = documents_of(docs, doc_id, text)
    tokens = corpus.select("doc_id", "text_key", words_of(F.col("text")).alias("words")).select(
        "doc_id", "text_key", F.size("words").alias("n_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    scanned = F.concat(F.array().cast("array<bigint>"),
                       *[windows_of(F.col("hashes"), F.col("n_words"), n) for n in lengths])
    probes = tokens.select("doc_id", "text_key", "n_words", F.posexplode_outer(scanned).alias("at", "probe"))
    # Windows of one length follow those of the shorter lengths; this is where each length begins.
    begin, before = F.lit(0), F.lit(0)
    for n in lengths:
        begin = F.when(F.col("length") == n, before).otherwise(begin)
        before = before + F.greatest(F.col("n_words") - (n - 1), F.lit(0))
    hits = probes.join(sized(hash_set), F.col("probe") == F.col("gram"), "left").filter(
        F.col("gram").isNotNull() | (F.coalesce(F.col("at"), F.lit(0)) == 0))
    found = F.when(F.col("gram").isNotNull(), F.struct(
        (F.col("at") - begin + 1).alias("first"), F.col("length").alias("length"), F.col("gram").alias("gram")))
    # The first probe of a row is always kept, so each document has its row and copies of a row can be counted.
    seen = stored(hits.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"), F.collect_set(found).alias("hits"),
        F.count_if(F.coalesce(F.col("at"), F.lit(0)) == 0).alias("copies")), "window-hits")

    suspects = seen.filter(F.size("hits") > 0).select(
        F.col("doc_id").alias("s_id"), F.col("text_key").alias("s_key"), "hits")
    # The ids of suspects, if few enough, pick their texts out of the scan; only these are shuffled to their hits.
    named = suspects.select(F.col("s_id").alias("n_id"), F.col("s_key").alias("n_key"))
    few = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    texts = corpus.join(few, F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("text_key") == F.col("n_key")), "left_semi")
    bodies = texts.join(suspects, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_key") == F.col("s_key")))
    spelled = bodies.select("doc_id", "text_key", "hits", words_of(F.col("text")).alias("words")).select(
        "doc_id", "text_key", F.explode(F.transform("hits", lambda h: F.struct(
            h["first"].alias("first"), h["length"].alias("length"), h["gram"].alias("gram"),
            F.array_join(F.slice("words", h["first"], h["length"]), " ").alias("gram_text")))).alias("h")
    ).select("doc_id", "text_key", "h.*")
    true_hits = stored(spelled.join(sized(grams.select("gram", "gram_text").distinct()), ["gram", "gram_text"], "left_semi"),
                       "window-hits")
    spans = true_hits.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("first", "length"))).alias("spans"))
    item_lists = (true_hits.select("doc_id", "text_key", "gram", "gram_text").distinct()
                  .join(sized(grams.select("gram", "gram_text", "item_id")), ["gram", "gram_text"])
                  .groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    spans = spans.toDF("p_id", "p_key", "spans")
    item_lists = item_lists.toDF("i_id", "i_key", "items")
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(
        F.greatest(a["end"], x["first"] + x["length"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), x["first"] + x["length"] - F.greatest(x["first"], a["end"]))).alias("n")),
        lambda a: a["n"])
    n_hit = F.when(F.col("spans").isNull(), F.lit(0).cast("long")).otherwise(covered)
    return (seen.join(spans, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("text_key") == F.col("p_key")), "left")
            .join(item_lists, F.col("doc_id").eqNullSafe(F.col("i_id")) & (F.col("text_key") == F.col("i_key")), "left")
            .select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    F.coalesce("spans", F.array().cast("array<struct<first:int,length:int>>")).alias("spans"),
                    F.explode(F.array_repeat(F.lit(1), F.greatest(F.col("copies"), F.lit(1)).cast("int"))).alias("one"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= min_percent * F.col("n_words")))
            .drop("one"))


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, verdicts: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", **options,
) -> DataFrame:
    """``docs`` without the contaminated documents; the others are unchanged."""
    verdicts = judge_documents(docs, benchmark, doc_id, text, **options) if verdicts is None else verdicts
    return keep_rows(docs, verdicts.filter("contaminated"), doc_id, text)


def remove_spans(docs: DataFrame, verdicts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the hit words cut out of every text: the other words, joined by one space, in texts with a hit."""
    hit = verdicts.filter("n_hit > 0").select(
        F.col("doc_id").alias("v_id"), F.col("text_key").alias("v_key"), F.col("spans").alias("v_spans")
    ).dropDuplicates(["v_id", "v_key"])
    body = F.col(f"d.`{text}`")
    raw = F.regexp_extract_all(body, F.lit(WORD), F.lit(0))
    rest = F.filter(raw, lambda w, i: ~F.exists(F.col("v.v_spans"), lambda s: (i + 1 >= s["first"]) & (i + 1 < s["first"] + s["length"])))
    return docs.alias("d").join(
        hit.alias("v"), F.col(f"d.`{doc_id}`").eqNullSafe(F.col("v.v_id")) & (F.xxhash64(body) == F.col("v.v_key")), "left"
    ).select(*[F.when(F.col("v.v_key").isNull(), body).otherwise(F.array_join(rest, " ")).alias(c) if c == text
               else F.col(f"d.`{c}`") for c in docs.columns])
