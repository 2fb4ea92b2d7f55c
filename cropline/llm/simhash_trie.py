"""SimHash near-dedup: 64-bit fingerprints joined with themselves over binary tries.

* **Fingerprint.** A-Z are lower-cased; the shingles of ``SHINGLE`` words, repeats included, joined by one space (all words as
  one where there are fewer) are hashed by XXH64 with seed 42. A bit is 1 if more than half of the hashes have it. A text
  without words has the fingerprint zero.
* **Join.** Equal fingerprints are one leaf. A trie is a sorted array; a node is the range of one prefix. Two nodes of the same
  depth are walked together: both are split by the next bit, a pair of children of unequal bits costs one error, and a pair
  is left as soon as its errors exceed the budget. Pairs of few leaves are compared by their differing bits at once.
* **Two tries.** A pair within ``budget`` bits has at most half of them in its first 32 bits or in its last 32 bits. So
  there is a trie of the fingerprints and one of the fingerprints with their halves exchanged, and in each the first 32
  bits have only half of the budget: the upper levels, where nearly all nodes meet, stay thin.
* **Units of work.** Both tries are cut into subtrees: nodes of at most ``UNIT`` leaves, found level by level in Spark from
  the counts of each prefix. A first pass walks each subtree with itself. A second pass walks the pairs of subtrees that are
  within the budget; each subtree is sent to its partners, whose number depends on its depth only.
* **Groups.** Thousands of near copies are all within the budget of each other. A walk goes through the errors 1, 2, ...
  one after the other and joins what it finds to classes; two nodes of which all leaves are of one class already are left
  at once, so the links inside a class are not listed. What leaves a walk is one row per leaf whose class changed.

Defined cases: null and blank texts have the fingerprint zero and are linked like any other; rows that share an id are
rows of their own; a null id takes part, and a component has its smallest non-null id, or null. Very long texts are hashed
in pieces. An empty table gives no rows. Other columns are not looked at, so their names never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropline.llm.common import components, stored, text_chunks

SHINGLE, SEED, BUDGET = 4, 42, 4
#: Leaves of a subtree that one task walks at most.
UNIT = 1 << 19
#: Smaller inputs are cut into about so many subtrees, so that several tasks walk them, but into none of fewer leaves than that.
SPREAD, LEAST_LEAVES = 16, 1024
#: Levels that a pair of too large nodes goes down at once.
STRIDE = 2
#: Node pairs that a walk holds at once, leaf pairs of a node pair that are compared directly, and hashes summed at once.
HELD, DIRECT, SUMMED = 1 << 18, 16, 1 << 16
#: Links that a walk collects before it joins their classes.
FOUND = 1 << 22
ONE = np.uint64(1)


# --- fingerprints ------------------------------------------------------------------------------------------------------

def word_spans(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts of ``buffer`` between single spaces."""
    at = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32)
    return np.concatenate([[0], at + 1]), np.concatenate([at, [len(buffer)]])


def fingerprint(text: bytes | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The words of ``text`` (bytes.split() parts at space, tab, LF, VT, FF and CR; bytes.lower() changes A-Z) as 64 votes."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    buffer = b" ".join(words)
    n = max(1, len(words) - size + 1)
    starts, ends = word_spans(buffer)
    starts, ends = starts[:n], ends[-n:]
    votes, hashed = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for lo in range(0, n, SUMMED):
        pieces = zip(starts[lo:lo + SUMMED].tolist(), ends[lo:lo + SUMMED].tolist())
        hashes = np.array([hashed(buffer[s:e], seed) for s, e in pieces], dtype=">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprinter(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            prints = [fingerprint(t, size, seed) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    return run


# --- the walk over two tries -------------------------------------------------------------------------------------------

def bits_of(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def exchanged(x: np.ndarray) -> np.ndarray:
    """The halves of each fingerprint exchanged."""
    return (x << np.uint64(32)) | (x >> np.uint64(32))


def runs_end(labels: np.ndarray) -> np.ndarray:
    """For each place the end of the run of equal labels that it lies in."""
    n = len(labels)
    ends = np.append(np.flatnonzero(labels[1:] != labels[:-1]) + 1, n)
    return ends[np.searchsorted(ends, np.arange(n), side="right")] if n else ends


def united(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``labels`` after the classes of a[i] and b[i] are joined; a label is a place, the smallest one of its class."""
    labels = labels.copy()
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:  # labels lead to smaller ones until one leads to itself
            nearer = labels[labels]
            if (nearer == labels).all():
                break
            labels = nearer


class Tries:
    """The sorted leaves of one subtree, or of two next to each other, with the classes of the leaves."""

    def __init__(self, leaves: np.ndarray, labels: np.ndarray):
        self.leaves, self.labels = leaves, labels

    def walk(self, start: tuple[int, int, int, int, int, int], budget: int, first: int) -> None:
        """Join the classes of leaves of the node pair ``start`` (a's range, b's range, depth, errors) within ``budget``
        errors, of which ``first`` may lie in the first 32 bits."""
        stack = [tuple(np.array([x]) for x in start)]
        found, total, ends = [], 0, runs_end(self.labels)
        while stack or found:
            if total > FOUND or not stack:
                self.labels = united(self.labels, *(np.concatenate(x) for x in zip(*found)))
                found, total, ends = [], 0, runs_end(self.labels)
                continue
            al, ah, bl, bh, depth, errors = stack.pop()
            if len(al) > HELD:
                half = len(al) // 2
                stack.append(tuple(x[half:] for x in (al, ah, bl, bh, depth, errors)))
                al, ah, bl, bh, depth, errors = (x[:half] for x in (al, ah, bl, bh, depth, errors))
                stack.append((al, ah, bl, bh, depth, errors))
                continue
            one_class = (ends[al] >= ah) & (ends[bl] >= bh) & (self.labels[al] == self.labels[bl])
            go = ~one_class
            small = go & (((ah - al) * (bh - bl) <= DIRECT) | (depth == 64))
            if small.any():
                near = self.compared(al[small], ah[small], bl[small], bh[small], budget)
                if len(near[0]):
                    found.append(near)
                    total += len(near[0])
            go &= ~small
            if go.any():
                stack.append(self.split(al[go], ah[go], bl[go], bh[go], depth[go], errors[go], budget, first))

    def compared(self, al, ah, bl, bh, budget) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places, of all leaves of the node pairs, that are within ``budget`` bits and of different classes."""
        n = (ah - al) * (bh - bl)
        owner = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        wide = (bh - bl)[owner]
        a, b = al[owner] + k // wide, bl[owner] + k % wide
        near = (self.labels[a] != self.labels[b]) & (bits_of(self.leaves[a] ^ self.leaves[b]) <= budget)
        return a[near], b[near]

    def split(self, al, ah, bl, bh, depth, errors, budget, first):
        """The pairs of children that are still within the budget."""
        bit = ONE << (63 - depth).astype(np.uint64)
        below = ~((bit << ONE) - ONE)  # the bits before this one
        am = np.searchsorted(self.leaves, (self.leaves[al] & below) | bit).clip(al, ah)
        bm = np.searchsorted(self.leaves, (self.leaves[bl] & below) | bit).clip(bl, bh)
        allowed = np.where(depth < 32, first, budget)
        same = al == bl  # a node with itself: one of the two mixed pairs is enough
        parts = []
        for a0, a1, b0, b1, cost, use in (
                (al, am, bl, bm, 0, True), (am, ah, bm, bh, 0, True), (al, am, bm, bh, 1, True), (am, ah, bl, bm, 1, ~same)):
            keep = (a0 < a1) & (b0 < b1) & (errors + cost <= allowed) & use
            parts.append((a0[keep], a1[keep], b0[keep], b1[keep], depth[keep] + 1, errors[keep] + cost))
        return tuple(np.concatenate(x) for x in zip(*parts))


def walked(fp: np.ndarray, label: np.ndarray, split_at: int, depth: int, errors: int, budget: int) -> np.ndarray:
    """Labels (fingerprints) of all leaves after the walk.

    ``fp`` are the sorted leaves of a's subtree, ``split_at`` of them, then of b's; with ``split_at`` 0 of one subtree with itself.
    """
    names, first_of = np.unique(label, return_inverse=True)
    smallest = np.full(len(names), len(fp), dtype=np.int64)
    np.minimum.at(smallest, first_of, np.arange(len(fp)))
    tries = Tries(fp, smallest[first_of])
    for errors_now in range(1, budget + 1):
        if split_at:
            start = (0, split_at, split_at, len(fp), depth, errors)
        else:
            start = (0, len(fp), 0, len(fp), depth, 0)
        if start[-1] <= errors_now:
            tries.walk(start, errors_now, errors_now // 2)
    return label[tries.labels]


def unit_walker(budget: int):
    """One unit: rows (leaf, label, side, depth, errors); what comes out are the leaves whose label changed."""
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        leaf = table.column("leaf").to_numpy().view(np.uint64)
        label = table.column("label").to_numpy().view(np.uint64)
        order = np.lexsort((leaf, side))
        leaf, label, side = leaf[order], label[order], side[order]
        n_left = int((side == 0).sum())
        split_at = n_left if n_left < len(side) else 0
        if split_at and leaf[0] > leaf[split_at]:  # keep the whole array sorted: the subtree of smaller prefixes comes first
            leaf, label = np.concatenate([leaf[split_at:], leaf[:split_at]]), np.concatenate([label[split_at:], label[:split_at]])
            split_at = len(side) - split_at
        out = walked(leaf, label, split_at, table.column("depth")[0].as_py(), table.column("errors")[0].as_py(), budget)
        moved = out != label
        return pa.table({"a": pa.array(label[moved].view(np.int64)), "b": pa.array(out[moved].view(np.int64))})

    return run


# --- Spark side --------------------------------------------------------------------------------------------------------

def prefix(leaf: Column, depth: int) -> Column:
    """The first ``depth`` bits of a leaf, as a number."""
    return F.call_function("shiftrightunsigned", leaf, F.lit(64 - depth)) if depth else F.lit(0).cast("long")


def units_of(leaves: DataFrame, limit: int, budget: int) -> DataFrame:
    """(trie, depth, a, b, errors): pairs of nodes, a <= b, of at most ``limit`` leaves each that are within the budget.

    Starts with each root and itself, and goes ``STRIDE`` levels down where a node of a pair has more leaves; the errors of a
    pair are the bits in which the two prefixes differ.
    """
    closed, depth = [], 0
    pairs = leaves.groupBy("trie").agg(F.count("*").alias("na")).select(
        "trie", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "na", F.col("na").alias("nb"), F.lit(0).alias("errors"))
    while True:
        pairs = stored(pairs, "node-pairs")
        fits = F.greatest("na", "nb") <= limit
        closed.append(pairs.filter(fits | F.lit(depth == 64)).select("trie", F.lit(depth).alias("depth"), "a", "b", "errors"))
        wide = pairs.filter(~fits)
        if depth == 64 or wide.isEmpty():
            break
        depth += STRIDE
        nodes = wide.select("trie", F.col("a").alias("node")).union(wide.select("trie", "b")).distinct()
        parent = lambda node: F.call_function("shiftrightunsigned", node, F.lit(STRIDE))
        counts = leaves.groupBy("trie", prefix(F.col("leaf"), depth).alias("child")).agg(F.count("*").alias("n"))
        counts = counts.withColumn("node", parent(F.col("child"))).join(nodes, ["trie", "node"], "left_semi")
        left = counts.select("trie", F.col("child").alias("ca"), F.col("n").alias("na"), F.col("node").alias("a"))
        right = left.toDF("trie", "cb", "nb", "b")
        differ = F.col("ca").bitwiseXOR(F.col("cb"))
        upper = F.call_function("shiftrightunsigned", differ, F.lit(max(0, depth - 32)))  # the bits of the first half
        pairs = wide.select("trie", "a", "b").join(left, ["trie", "a"]).join(right, ["trie", "b"]).filter(
            ((F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb"))) & (F.bit_count(differ) <= budget)
            & (F.bit_count(upper) <= budget // 2)).select(
            "trie", F.col("ca").alias("a"), F.col("cb").alias("b"), "na", "nb", F.bit_count(differ).cast("int").alias("errors"))
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return stored(out, "trie-units")


def walk_units(leaves: DataFrame, units: DataFrame, budget: int) -> DataFrame:
    """Edges (a, b) between labels that the walks of ``units`` join. ``leaves``: trie, leaf, label."""
    depths = sorted(r[0] for r in units.select("depth").distinct().collect())  # at most 64 / STRIDE + 1 numbers
    if not depths:
        return leaves.select(F.col("label").alias("a"), F.col("label").alias("b")).limit(0)
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), prefix(F.col("leaf"), d).alias("node")) for d in depths]))
    placed = leaves.select("trie", "leaf", "label", at.alias("at")).select("trie", "leaf", "label", "at.depth", "at.node")
    key = ["trie", "depth", "a", "b", "errors"]
    sides = units.select(*key, F.col("a").alias("node"), F.lit(0).alias("side")).union(
        units.filter("a <> b").select(*key, F.col("b").alias("node"), F.lit(1).alias("side")))
    rows = placed.join(sides, ["trie", "depth", "node"]).select(*key, "leaf", "label", "side")
    return stored(rows.groupBy("trie", "depth", "a", "b").applyInArrow(unit_walker(budget), "a long, b long").distinct(), "trie-edges")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is the fingerprint as a signed long."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return stored(rows.mapInArrow(fingerprinter(size, seed), f"doc_id {kind}, fp long"), "fingerprints")


def classes(prints: DataFrame, budget: int = BUDGET, unit: int = UNIT) -> DataFrame:
    """(fp, label) of the fingerprints that are linked with another one; label is the smallest fingerprint of the component."""
    distinct = stored(prints.select("fp").distinct(), "distinct-fingerprints")
    halves = F.call_function("shiftrightunsigned", F.col("fp"), F.lit(32)).bitwiseOR(F.shiftleft("fp", 32))
    both = F.explode(F.array(F.struct(F.lit(0).alias("trie"), F.col("fp").alias("leaf")), F.struct(F.lit(1).alias("trie"), halves.alias("leaf"))))
    leaves = distinct.select("fp", both.alias("x")).select("fp", "x.trie", "x.leaf")
    limit = min(unit, max(LEAST_LEAVES, distinct.count() // SPREAD))
    units = units_of(leaves, limit, budget)
    inside = walk_units(leaves.withColumn("label", F.col("fp")), units.filter("a = b"), budget)
    known = components(inside).toDF("fp", "known")
    labelled = leaves.join(known, "fp", "left").select("trie", "leaf", F.coalesce("known", "fp").alias("label"))
    across = walk_units(stored(labelled, "trie-leaves"), units.filter("a <> b"), budget)
    return components(inside.union(across)).toDF("fp", "label")


def judge_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, seed: int = SEED,
                    budget: int = BUDGET, unit: int = UNIT) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = fingerprints(docs, doc_id, text, size, seed)
    labels = classes(prints, budget, unit)
    # Components are worked out for distinct fingerprints, before documents are met again.
    leaves = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(labels, "fp", "left")
    linked = leaves.filter("label is not null")
    firsts = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    named = stored(linked.join(firsts, "label").select("fp", "component_id").unionByName(
        leaves.filter("label is null").select("fp", F.col("first").alias("component_id"))), "fingerprint-components")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, verdicts: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows without an id stay."""
    gone = verdicts.filter("doc_id > component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")
