"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers that no base pattern covers.

Base spans (email, ip, card, phone) are found by regular expressions; places come from the lengths of the pieces that
``split`` leaves between the matches, added up per text and kind by a window.

Bootstrap: the seed entities' contexts, the one and the two words before them, induce lexical patterns. Candidates are
all identifier-like tokens of the corpus (white-space tokens with a digit or an at sign, without brackets, quotes and end
punctuation) that touch no base span. Patterns and values form a graph: an edge for each value that a pattern stands
before, with its number of times. A pattern's confidence is the sum of times and scores of its values over the times that
it stands before any token of the corpus, so a common word in front of a few seeds scores near zero. A value's score is 1
for seeds and 1 - prod(1 - confidence) over its patterns otherwise. After ``rounds`` rounds, values of at least
``min_score`` behind a pattern of at least ``min_confidence`` and ``min_seeds`` distinct seed values become spans of the
kind that the pattern's seeds mostly have.

All of it is DataFrame expressions. Pattern counts are aggregated before each join; the pattern set is broadcast only
below a checked size.

Defined cases: null texts are empty; rows with the same id and text are one document, and each gets its row in the
result; places are code points, end exclusive; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropline.llm.common import documents_of, stored

KINDS = ("email", "ip", "card", "phone")

# Each matches what the plain pattern matches from the left, in time linear in the text: a run is entered at its start or
# where the last match ended (\G), and repetitions that nothing follows are possessive.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried at all.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TOKEN = r"(?<![^\s])[^\s0-9@]*+[0-9@][^\s]*+"
SPACE = r"\s"
#: Rows of the pattern set (a short text each) that may be broadcast.
BROADCAST_ROWS = 200_000


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass: from the right, every second digit is doubled."""
    d = F.reverse(digits(value))
    places = F.sequence(F.lit(1), F.length(d))
    total = F.aggregate(places, F.lit(0), lambda t, i: t + F.when(
        i % 2 == 1, F.substring(d, i, 1).cast("int")).otherwise(
        F.substring(d, i, 1).cast("int") * 2 - F.when(F.substring(d, i, 1).cast("int") > 4, 9).otherwise(0)))
    return total % 10 == 0


def passes(kind: str, value: Column) -> Column:
    count = F.length(digits(value))
    if kind == "card":
        return F.when((count >= 13) & (count <= 19), luhn(value)).otherwise(F.lit(False))
    if kind == "phone":
        return (count >= 9) & (count <= 15)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.when(
            F.length(F.ltrim(p, F.lit("0"))) > 3, F.lit(False)).otherwise(
            F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))).cast("int") <= 255))
    return F.lit(True)


def matches(rows: DataFrame, patterns: dict[str, str], hints: dict[str, str]) -> DataFrame:
    """(doc_id, text_key, kind, value, start, end, before) of all matches of rows (doc_id, text_key, text).

    ``before`` is the text since the last match of that kind, its last 400 code points at most.
    """
    found = []
    for kind, pattern in patterns.items():
        tried = F.col("text").rlike(pattern)
        if hints.get(kind):
            tried = F.col("text").contains(hints[kind]) & tried
        parts = F.split("text", pattern, -1)
        values = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        found.append(F.when(tried, F.transform(F.arrays_zip(parts.alias("p"), values.alias("v")), lambda x: F.struct(
            F.lit(kind).alias("kind"), x["v"].alias("value"), F.length(x["p"]).alias("gap"),
            F.right(x["p"], F.lit(400)).alias("before")))))
    empty = F.array().cast("array<struct<kind:string,value:string,gap:int,before:string>>")
    flat = rows.select("doc_id", "text_key", F.posexplode(F.concat(*[F.coalesce(x, empty) for x in found])).alias("no", "m"))
    flat = flat.select("doc_id", "text_key", "no", "m.*").dropDuplicates(["doc_id", "text_key", "kind", "no"])
    order = Window.partitionBy("doc_id", "text_key", "kind").orderBy("no")
    gaps = F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0))
    values = F.coalesce(F.sum(F.length("value")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return flat.select("doc_id", "text_key", "kind", "value", (gaps + values).cast("long").alias("start"), "before").filter("value is not null").withColumn(
        "end", F.col("start") + F.length("value"))


def base_spans(rows: DataFrame) -> DataFrame:
    ok = F.lit(False)
    for kind in KINDS:
        ok = F.when(F.col("kind") == kind, passes(kind, F.col("value"))).otherwise(ok)
    return matches(rows, PATTERNS, HINTS).filter(ok)


def contexts(before: Column) -> Column:
    """The patterns of a place: the word before it, and the two words before it."""
    words = F.filter(F.split(F.lower(before), SPACE + "+"), lambda w: w != "")
    n = F.size(words)
    return F.filter(F.array(
        F.when(n >= 1, F.element_at(words, -1)),
        F.when(n >= 2, F.concat_ws(" ", F.slice(words, n - 1, 2)))), lambda c: c.isNotNull())


def pattern_key(pattern: Column) -> Column:
    words = F.split(pattern, " ")
    first, second = F.xxhash64(F.get(words, F.lit(0))), F.xxhash64(F.get(words, F.lit(1)))
    return F.when(F.size(words) == 1, first).otherwise(F.xxhash64(first, second))


def discover(rows: DataFrame, base: DataFrame, rounds: int = 3, min_score: float = 0.8, min_confidence: float = 0.8,
             min_seeds: int = 3) -> DataFrame:
    """New spans (doc_id, text_key, kind, start, end) found by context."""
    cleaned = r"^[^\p{L}\p{N}+@#]+|[^\p{L}\p{N}]+$"
    tokens = matches(rows, {"token": TOKEN}, {})
    lead = F.length("value") - F.length(F.regexp_replace("value", r"^[^\p{L}\p{N}+@#]+", ""))
    tokens = tokens.select("doc_id", "text_key", "before", (F.col("start") + lead).alias("start"),
                           F.regexp_replace("value", cleaned, "").alias("value"))
    tokens = tokens.withColumn("end", F.col("start") + F.length("value")).filter(F.length("value") >= 4)
    spans = base.select(F.col("doc_id").alias("b_id"), F.col("text_key").alias("b_key"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    free = tokens.join(spans, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_key") == F.col("b_key"))
                       & (F.col("start") < F.col("b_end")) & (F.col("end") > F.col("b_start")), "left_anti")
    seeds = base.select("kind", "value", F.explode(contexts(F.col("before"))).alias("pattern"))
    # Patterns that enough distinct seeds have; the others can never be used.
    kinds = seeds.groupBy("pattern", "kind").agg(F.count_distinct("value").alias("n"))
    patterns = stored(kinds.groupBy("pattern").agg(F.sum("n").alias("n_seeds"), F.max_by("kind", F.struct("n", "kind")).alias("kind"))
                      .filter(F.col("n_seeds") >= min_seeds), "pii-patterns")
    sized = F.broadcast if patterns.count() <= BROADCAST_ROWS else (lambda df: df)
    free = stored(free.withColumn("pattern", F.explode(contexts(F.col("before")))).join(
        sized(patterns.select("pattern")), "pattern").select("doc_id", "text_key", "start", "end", "value", "pattern"), "pii-candidates")

    # How often each pattern stands before any token of the corpus.
    words = F.filter(F.split(F.lower("text"), SPACE + "+"), lambda w: w != "")
    hashed = rows.select(F.transform(words, lambda w: F.xxhash64(w)).alias("w"))
    n = F.size("w")
    pairs = F.when(n > 2, F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.xxhash64(F.get("w", i - 2), F.get("w", i - 1)))
                   ).otherwise(F.array().cast("array<bigint>"))
    places = hashed.filter(n > 1).select(F.explode(F.concat(F.slice("w", 1, n - 1), pairs)).alias("key"))
    keyed = patterns.select("pattern", pattern_key(F.col("pattern")).alias("key"))
    followed = stored(places.join(sized(keyed), "key").groupBy("pattern").agg(F.count("*").alias("times")), "pii-followed")

    known = seeds.join(sized(patterns.select("pattern")), "pattern").select("pattern", "value", F.lit(True).alias("seed"))
    edges = stored(known.union(free.select("pattern", "value", F.lit(False))).groupBy("pattern", "value").agg(
        F.max("seed").alias("seed"), F.count("*").alias("n")), "pii-edges")
    scores = edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("score"))
    confidence = None
    for _ in range(rounds):
        sums = edges.join(scores, "value").groupBy("pattern").agg(
            F.sum(F.col("score") * F.col("n")).alias("sum"))
        confidence = stored(sums.join(followed, "pattern").select(
            "pattern", F.least(F.lit(1.0), F.col("sum") / F.col("times")).alias("confidence")), "pii-confidence")
        missed = F.product(F.lit(1.0) - F.col("confidence"))
        scores = stored(edges.join(confidence, "pattern").groupBy("value").agg(
            F.when(F.max("seed"), F.lit(1.0)).otherwise(1 - missed).alias("score")), "pii-scores")
    sure = patterns.join(confidence.filter(F.col("confidence") >= min_confidence), "pattern").select("pattern", "kind", "confidence")
    hits = free.join(sure, "pattern").join(scores.filter(F.col("score") >= min_score).select("value"), "value", "left_semi")
    return hits.groupBy("doc_id", "text_key", "start", "end").agg(F.max_by("kind", F.struct("confidence", "pattern")).alias("kind"))


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, text_key, ``base`` and ``spans``, arrays of (kind, start, end) in the order of KINDS."""
    rows = documents_of(docs, doc_id, text).withColumn("text", F.coalesce("text", F.lit("")))
    base = stored(base_spans(rows).select("doc_id", "text_key", "kind", "value", "start", "end", "before"), "pii-base")
    new = discover(rows, base, **options)
    marked = base.select("doc_id", "text_key", "kind", "start", "end", F.lit(True).alias("is_base")).union(
        new.select("doc_id", "text_key", "kind", "start", "end", F.lit(False)))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    listed = marked.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct(
        rank.alias("rank"), "start", "end", "kind", "is_base"))).alias("all")).toDF("s_id", "s_key", "all")
    none = F.array().cast("array<struct<rank:bigint,start:bigint,end:bigint,kind:string,is_base:boolean>>")
    found = rows.select("doc_id", "text_key").join(
        listed, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_key") == F.col("s_key")), "left")
    every = F.coalesce("all", none)
    return found.select("doc_id", "text_key", F.filter(every, lambda x: x["is_base"]).alias("base"), every.alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def mask(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; of overlapping spans the first one that starts is used."""
    found = spans.filter(F.size("spans") > 0).select(
        F.col("doc_id").alias("m_id"), F.col("text_key").alias("m_key"), F.col("spans").alias("m_spans")).dropDuplicates(["m_id", "m_key"])
    body = F.col(f"d.`{text}`")
    ordered = F.array_sort(F.transform("m.m_spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    done = F.aggregate(ordered, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), lambda a, x: F.when(
        x["start"] < a["at"], a).otherwise(F.struct(
            F.concat(a["out"], F.substring(body, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")),
                     F.lit("["), x["kind"], F.lit("]")).alias("out"), x["end"].alias("at"))))
    masked = F.get(F.transform(F.array(done), lambda a: F.concat(a["out"], F.substring(body, (a["at"] + 1).cast("int"), F.length(body)))), F.lit(0))
    return docs.alias("d").join(
        found.alias("m"), F.col(f"d.`{doc_id}`").eqNullSafe(F.col("m.m_id"))
        & (F.xxhash64(F.coalesce(body, F.lit(""))) == F.col("m.m_key")), "left"
    ).select(*[F.when(F.col("m.m_key").isNull(), body).otherwise(masked).alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns])
