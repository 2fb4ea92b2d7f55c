"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posterior labels.

Voters. Lexicon voters are families of words or word beginnings (4 to 8 letters, so that inflected and compound forms
count) that are common enough in toxic training rows and nearly absent from clean ones; a fixed list of general insults
is one more. Pattern voters look at the form: several words that are less surely toxic, several lexicon hits, dense hits,
shouting, runs of marks, a single hit, and no hit at all. A voter that does not fire abstains. Counts behind
the lexicon are taken in Spark over all labelled training rows.

Label model. Every document's votes are one bit pattern; patterns are counted over all documents in Spark. There are at
most 2^``MAX_VOTERS`` patterns, whatever the number of documents, and the model is fitted on that table: EM estimates
each voter's rate among toxic and clean documents and the correlations of voters within a class; a voter's evidence is
divided by one plus its correlations. Labelled training rows keep their label in the expectation step and give the share of
toxic documents; the others count with a tenth of their weight, so that the classes keep their meaning.

Classifier. Logistic regression on the votes and on hashed words and word beginnings, fitted to the posterior labels of a
bounded sample of training rows (``max_train`` per class, by hash of the row), weighted to the classes' full sizes. The
score of a document uses its text alone.

Defined cases: null texts are empty; empty texts have no votes and a score; a null document id is scored and never
trains; several label rows of one id count as toxic if any is 1, null labels do not count; without labelled rows of both
classes the fixed list and the pattern voters alone vote, with set rates; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropline.llm.common import keep_rows, stored, text_chunks

MAX_VOTERS = 20
FORMS = 7  # pattern voters
LEXICON_VOTERS = MAX_VOTERS - FORMS - 1
FEATURES = 1 << 16
#: Sampled rows that the classifier reads at a time.
BLOCK_ROWS = 500
#: Label rows (an id and a flag each) that may be broadcast.
BROADCAST_LABELS = 1_000_000
#: Words are runs of ASCII letters and of characters outside ASCII: all other bytes become spaces.
SPACED = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
SHOUT, MARKS = re.compile("[A-Z]{3,}"), re.compile("[!?]{2,}")
STEMS = (4, 5, 6, 7, 8)

# General insults.
INSULTS = ("bastard", "clown", "cretin", "disgusting", "dumb", "fool", "garbage", "idiot", "imbecile", "jerk", "loser", "moron",
           "pathetic", "scum", "stupid", "trash", "vermin", "worthless")


def terms_of(word: str) -> list[str]:
    """The word itself, and its beginnings with a star."""
    return [word, *[word[:k] + "*" for k in STEMS if len(word) >= k]]


class Words:
    """The distinct words of each text of a chunk: ``owner[i]`` has the word ``distinct[code[i]]``."""

    def __init__(self, texts: list[str | None]):
        lists = [t.lower().encode().translate(SPACED).split() if t else [] for t in texts]
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        flat = np.empty(int(sizes.sum()), dtype=object)
        flat[:] = [w for x in lists for w in x]
        codes, distinct = pd.factorize(flat) if len(flat) else (np.empty(0, np.int64), flat)
        self.distinct = np.empty(len(distinct), dtype=object)
        self.distinct[:] = [w.decode() for w in distinct]
        enough = np.fromiter((len(w) > 2 for w in self.distinct), dtype=bool, count=len(self.distinct))
        owner = np.repeat(np.arange(len(lists)), sizes)[enough[codes]]
        n = max(1, len(self.distinct))
        pairs = np.unique(owner * n + codes[enough[codes]])
        self.owner, self.code, self.texts = pairs // n, pairs % n, texts

    def per_text(self, weights: np.ndarray | None = None) -> np.ndarray:
        """Sums over each text's words; without weights their number."""
        return np.bincount(self.owner, weights=None if weights is None else weights[self.code], minlength=len(self.texts))


def term_counter(wanted: frozenset[str] | None):
    """Documents of each term, of all terms or of the wanted ones."""
    starts = None if wanted is None else frozenset(t.rstrip("*")[:STEMS[0]] for t in wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            words = Words(batch.column("text").to_pylist())
            numbers: dict[str, int] = {}
            lists = [[] if starts is not None and w[:STEMS[0]] not in starts else [
                numbers.setdefault(t, len(numbers)) for t in terms_of(w) if wanted is None or t in wanted] for w in words.distinct]
            sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            flat = np.fromiter((t for x in lists for t in x), dtype=np.int64, count=int(sizes.sum()))
            at = np.cumsum(sizes) - sizes
            each = sizes[words.code]
            place = np.repeat(at[words.code] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            docs = np.unique(np.repeat(words.owner, each) * max(1, len(numbers)) + flat[place]) % max(1, len(numbers))
            counts = np.bincount(docs, minlength=len(numbers))
            yield pa.RecordBatch.from_pydict({"term": pa.array(list(numbers), pa.string()), "n": pa.array(counts[:len(numbers)], pa.int64())})

    return run


def choose_families(terms: pd.DataFrame, weak_support: float, min_precision: float, weak_precision: float = 0.5) -> tuple[list[list[str]], list[str]]:
    """Voters' terms, the strongest families first, those beyond the last but one in the last voter; and the weaker terms."""
    precision = terms.toxic / (terms.toxic + terms.clean + 0.1)
    weak = sorted(terms.term[(precision >= weak_precision) & (precision < min_precision) & (terms.toxic >= weak_support)])
    terms = terms[precision >= min_precision]
    terms = terms.assign(size=terms.term.str.len()).sort_values(["toxic", "size", "term"], ascending=[False, False, True])
    families: dict[str, list[str]] = {}
    for term in terms.term:
        families.setdefault(term.rstrip("*")[:4], []).append(term)
    ordered = list(families.values())
    return ordered[:LEXICON_VOTERS - 1] + ([[t for f in ordered[LEXICON_VOTERS - 1:] for t in f]] if len(ordered) >= LEXICON_VOTERS else []), weak


class Voters:
    """Votes of texts by their words and form."""

    def __init__(self, lexicon: tuple[list[list[str]], list[str]]):
        families, weak = lexicon
        self.bits = {t: 1 << i for i, family in enumerate(families) for t in family}
        for word in INSULTS:
            self.bits[word] = self.bits.get(word, 0) | 1 << LEXICON_VOTERS
        for term in weak:
            self.bits[term] = self.bits.get(term, 0) | 1 << MAX_VOTERS
        self.starts = frozenset(t.rstrip("*")[:STEMS[0]] for t in self.bits)

    def of_word(self, word: str) -> int:
        if word[:STEMS[0]] not in self.starts:
            return 0
        bits = 0
        for t in terms_of(word):
            bits |= self.bits.get(t, 0)
        return bits

    def __call__(self, words: Words) -> np.ndarray:
        bits = np.fromiter(map(self.of_word, words.distinct), dtype=np.int64, count=len(words.distinct))
        strong = bits & ((1 << MAX_VOTERS) - 1)
        out = np.zeros(len(words.texts), dtype=np.int64)
        voted = np.flatnonzero(strong[words.code])
        np.bitwise_or.at(out, words.owner[voted], strong[words.code[voted]])
        hits, weak = words.per_text((strong > 0).astype(float)), words.per_text((bits > 0).astype(float))
        shout = np.array([bool(t) and 4 * sum(map(len, SHOUT.findall(t))) > len(t) > 20 for t in words.texts], dtype=bool)
        marks = np.array([bool(t) and len(MARKS.findall(t)) > 1 for t in words.texts], dtype=bool)
        forms = (weak >= 3, hits >= 2, (hits >= 1) & (hits * 50 >= words.per_text()), shout, marks, hits == 1, hits == 0)
        for i, x in enumerate(forms):
            out |= x.astype(np.int64) << (LEXICON_VOTERS + 1 + i)
        return out


def hashed(words: Words) -> np.ndarray:
    """The two features of each distinct word: the word and its beginning."""
    if not len(words.distinct):
        return np.empty((0, 2), dtype=np.int64)
    begin = np.empty(len(words.distinct), dtype=object)
    begin[:] = [w[:5] + "*" for w in words.distinct]
    codes, begins = pd.factorize(begin)
    return np.column_stack([pd.util.hash_array(words.distinct, categorize=False) % FEATURES,
                            (pd.util.hash_array(begins, categorize=False) % FEATURES)[codes]]).astype(np.int64)


def voter(lexicon: tuple[list[list[str]], list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote = Voters(lexicon)
        for batch in text_chunks(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(vote(Words(batch.column("text").to_pylist())), pa.int32())],
                ["doc_id", "text_key", "votes"])

    return run


def featurizer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches):
        words = Words(batch.column("text").to_pylist())
        flat = hashed(words)[words.code].reshape(-1)
        offsets = np.concatenate([[0], np.cumsum(2 * words.per_text())])
        yield pa.RecordBatch.from_arrays(
            [batch.column("votes"), pa.array(np.bincount(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), weights=flat, minlength=len(
                offsets) - 1).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))],
            ["votes", "total", "features"])


def scorer(lexicon: tuple[list[list[str]], list[str]], vote_weights: np.ndarray, weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote = Voters(lexicon)
        for batch in text_chunks(batches):
            words = Words(batch.column("text").to_pylist())
            z = bias + bit_matrix(vote(words)) @ vote_weights
            if len(words.distinct):
                z = z + words.per_text(weights[hashed(words)].sum(axis=1)) / np.sqrt(np.maximum(1, 2 * words.per_text()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "text_key", "score"])

    return run


def bit_matrix(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] >> np.arange(MAX_VOTERS) & 1).astype(float)


class LabelModel:
    """Rates of each voter by class, evidence weights from correlations, and the share of toxic documents."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 30,
                 unlabelled_weight: float = 0.1):
        """One entry per (pattern, label); a label is 0, 1, or -1 where there is none."""
        bits, given = bit_matrix(patterns), labels >= 0
        q = np.where(labels == 1, 1.0, 0.0)
        both = (counts[labels == 1].sum() > 0) and (counts[labels == 0].sum() > 0)
        use = given if both else np.zeros(len(labels), dtype=bool)
        self.weight = np.ones(MAX_VOTERS)
        if both:
            self.share = counts[labels == 1].sum() / counts[given].sum()
            self.rates = [self.mean(bits[use], counts[use] * m) for m in (1 - q[use], q[use])]
        else:
            self.share, self.rates = 0.05, [np.full(MAX_VOTERS, 0.01), np.full(MAX_VOTERS, 0.5)]
            self.rates[0][-1], self.rates[1][-1] = 0.9, 0.1  # no hit at all
        for _ in range(rounds if len(patterns) and both else 0):
            q = np.where(use, q, self.posterior(patterns))
            mass = counts * np.where(use, 1.0, unlabelled_weight)
            self.rates = [self.mean(bits, mass * m) for m in (1 - q, q)]
            self.correlations = sum(share * self.correlation(bits, mass * m, r) for share, m, r in (
                (1 - self.share, 1 - q, self.rates[0]), (self.share, q, self.rates[1])))
            apart = np.clip(self.correlations, 0, 1) - np.eye(MAX_VOTERS)
            self.weight = 1 / (1 + np.clip(apart, 0, 1).sum(axis=1))

    @staticmethod
    def mean(bits: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return np.clip((weight @ bits + 0.1) / (weight.sum() + 1.0), 1e-5, 1 - 1e-5)

    @staticmethod
    def correlation(bits: np.ndarray, weight: np.ndarray, rate: np.ndarray) -> np.ndarray:
        away = bits - rate
        spread = np.sqrt(rate * (1 - rate))
        out = (away * weight[:, None]).T @ away / max(weight.sum(), 1e-9) / np.outer(spread, spread)
        np.fill_diagonal(out, 1.0)
        return out

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        bits = bit_matrix(patterns)
        clean, toxic = self.rates
        z = np.log(self.share / (1 - self.share)) + bits @ (self.weight * np.log(toxic / clean))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(votes: np.ndarray, columns: np.ndarray, sizes: np.ndarray, target: np.ndarray, weight: np.ndarray,
               rounds: int = 150, l2_votes: float = 1e-4, l2_words: float = 1e-2) -> tuple[np.ndarray, np.ndarray, float]:
    """Weighted logistic regression by Adam; a row's words are ``sizes`` features of ``columns``, scaled by their root."""
    bits, ends = bit_matrix(votes), np.cumsum(sizes)
    w = [np.zeros(MAX_VOTERS), np.zeros(FEATURES), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    weight = weight / max(weight.sum(), 1e-9)
    for t in range(1, rounds + 1):
        gradient = [l2_votes * w[0], l2_words * w[1], np.zeros(1)]
        for at in range(0, len(sizes), BLOCK_ROWS):  # only a block's words are widened to floats
            part = slice(at, at + BLOCK_ROWS)
            words = columns[ends[at] - sizes[at]:ends[part][-1]]
            scale = 1 / np.sqrt(np.maximum(sizes[part], 1))
            owner = np.repeat(np.arange(len(scale)), sizes[part])
            z = bits[part] @ w[0] + np.bincount(owner, weights=w[1][words], minlength=len(scale)) * scale + w[2][0]
            error = weight[part] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[part])
            gradient[0] += bits[part].T @ error
            gradient[1] += np.bincount(words, weights=(error * scale)[owner], minlength=FEATURES)
            gradient[2] += error.sum()
        for i, (g, rate) in enumerate(zip(gradient, (0.3, 0.02, 0.3))):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            w[i] -= rate * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.99 ** t)) + 1e-9)
    return w[0], w[1], float(w[2][0])


def score_documents(
    docs: DataFrame, labels: DataFrame, trains: Column | None = None, doc_id: str = "doc_id", text: str = "text",
    label: str = "toxic", min_support: float = 0.01, min_precision: float = 0.97, max_train: int = 4000, threshold: float = 0.3,
) -> DataFrame:
    """(doc_id, text_key, score, predicted) of all documents. ``trains`` (over the column doc_id) names the training rows."""
    trains = F.lit(True) if trains is None else trains
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"),
                       F.col(text).cast("string").alias("text"))
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).alias("toxic")).filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & trains).groupBy("doc_id").agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sides = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sized = F.broadcast if sum(sides.values()) <= BROADCAST_LABELS else (lambda df: df)
    labelled = rows.join(sized(known), "doc_id")

    def count_terms(toxic: int, wanted: frozenset[str] | None) -> DataFrame:
        part = labelled.filter(F.col("toxic") == toxic).select("text")
        return part.mapInArrow(term_counter(wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))

    lexicon: tuple[list[list[str]], list[str]] = ([], [])
    if sides.get(0) and sides.get(1):
        # At most (terms of a text) / min_support terms can be in that share of the toxic rows.
        common = count_terms(1, None).filter(F.col("n") >= max(3, min_support * sides[1])).toPandas()
        clean = count_terms(0, frozenset(common.term)).toPandas()
        terms = common.merge(clean, on="term", how="left", suffixes=("", "_clean")).fillna({"n_clean": 0})
        terms = terms.rename(columns={"n": "toxic", "n_clean": "clean"})
        lexicon = choose_families(terms, 2 * min_support * sides[1], min_precision)

    votes = stored(rows.mapInArrow(voter(lexicon), "doc_id long, text_key long, votes int"), "votes")
    judged = votes.join(sized(known), "doc_id", "left").withColumn("toxic", F.coalesce("toxic", F.lit(-1)))
    table = judged.groupBy("votes", "toxic").agg(F.count("*").alias("n")).toPandas().sort_values(["votes", "toxic"])
    model = LabelModel(table.votes.to_numpy(np.int64), table.n.to_numpy(float), table.toxic.to_numpy(np.int64))

    # A row that is repeated very often must not fill the sample, nor what is brought to the driver.
    sample = judged.filter(F.coalesce(trains, F.lit(False)) & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text_key"])
    likely = [int(v) for v, p in zip(table.votes, model.posterior(table.votes.to_numpy(np.int64))) if p >= 0.5]
    is_likely = F.col("votes").isin(sorted(set(likely))) if likely else F.lit(False)
    order = F.xxhash64("doc_id", "text_key")
    chosen = sample.filter(is_likely).orderBy(order, "doc_id").limit(max_train).union(
        sample.filter(~is_likely).orderBy(order, "doc_id").limit(max_train))  # at most 2 * max_train rows
    chosen = stored(chosen.select("doc_id", "text_key", "votes"), "toxicity-sample")
    bodies = rows.join(F.broadcast(chosen), ["doc_id", "text_key"]).groupBy("doc_id", "text_key").agg(
        F.first("text").alias("text"), F.first("votes").alias("votes"))
    made = bodies.select("text", "votes").mapInArrow(featurizer, "votes int, total long, features array<int>").toArrow()
    lists = made.column("features").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((made.column("total").to_numpy(), sizes, made.column("votes").to_numpy()))  # the same order at every attempt
    bits, sizes = made.column("votes").to_numpy()[order].astype(np.int64), sizes[order]
    columns = lists.take(pa.array(order)).flatten().to_numpy()
    target = model.posterior(bits)
    high = np.isin(bits, likely)
    total = table.assign(high=np.isin(table.votes, likely)).groupby("high").n.sum()
    weight = np.where(high, total.get(True, 0) / max(1, high.sum()), total.get(False, 0) / max(1, (~high).sum()))
    vote_weights, word_weights, bias = fit_linear(bits, columns, sizes, target, weight)
    scored = rows.mapInArrow(scorer(lexicon, vote_weights, word_weights, bias), "doc_id long, text_key long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, scores: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents predicted toxic."""
    return keep_rows(docs, scores.filter("predicted = 1"), doc_id, text)
