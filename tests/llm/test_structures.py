"""Conversation repair, fingerprint tries and importance resampling next to plain versions of their rules."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cropline.llm import conversation_repair as repair
from cropline.llm import ngram_jaccard
from cropline.llm import ngram_resampling as resampling
from cropline.llm import simhash_trie as trie
from tests.llm.helpers import EDGE, WORDS, ascii_lower, documents, sentence

# --- conversations -----------------------------------------------------------------------------------------------------

BLANKS = " \t\n\x0b\x0c\r"


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(BLANKS)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, lines) by trying every edit of one row after the other, from each role that may come last."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user:", "a": "assistant:"}
    best = {"": (0, "", ())}

    def inserted(ways):
        for _ in range(2):  # a third insertion would only repeat the first one's role
            for last, (cost, audit, lines) in list(ways.items()):
                for x in follow[last].replace("s", ""):
                    way = (cost + 3, audit + "I", (*lines, full[x]))
                    ways[x] = min(ways.get(x, way), way)
        return ways

    best = inserted(best)
    for (_, role, text), fault in zip(rows, faults_of(rows)):
        nexts = {}
        for last, (cost, audit, lines) in best.items():
            ways = [(last, (cost + 4, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                for x in follow[last]:
                    if role[:1] == x:
                        ways.append((x, (cost + more, audit + "K", (*lines, f"{role}:{text}"))))
                    if x != "s":
                        ways.append((x, (cost + more + 3, audit + "R", (*lines, full[x] + text))))
            for x, way in ways:
                nexts[x] = min(nexts.get(x, way), way)
        best = inserted(nexts)
    return min(best[x] for x in ("", "a") if x in best)


def judged(rows):
    turns = [t for t, _, _ in rows if t is not None]
    faults = faults_of(rows)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, lines = cheapest(rows)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows):
    """rows: (conv_id, turn, role, text, copies)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if role is None else role, " " if text is None else text) for c, t, role, text, n in rows if c == conv for _ in range(n)]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:repair.HEAD]))
        out[conv] = judged(own)
    return out


TURNS = "conv_id long, turn long, role string, text string, copies int, span string, part string, n string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS)


@pytest.fixture
def talk():
    draw = random.Random(3)
    texts = ["Yes.", "No!", "cut short", "", " \n\t", None, "Why?", "so . ", "Well.\n"]
    roles = ["system", "user", "assistant", "user", "assistant", None, "tool", ""]
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(draw.randrange(0, 12)):
            body = draw.choice(texts)
            if body and draw.random() < 0.6:
                body = f"{turn} {body}"
            rows.append((conv, draw.choice([turn, turn, turn, None, 3]), draw.choice(roles), body, draw.choice([1, 1, 1, 1, 0, 2, 3])))
    rows += [(99, i, ["user", "assistant"][i % 2], f"line {i}.", 1) for i in range(50)]  # many spans
    return [*rows, (100, 0, "user", "gone", 0), (101, 1, "user", "a very long text " * 5_000 + ".", 1)]


@pytest.mark.parametrize("rows_of_a_span, fan_in", [(256, 16), (3, 2)])
def test_cheapest_repairs(spark, talk, monkeypatch, rows_of_a_span, fan_in):
    monkeypatch.setattr(repair, "SPAN_ROWS", rows_of_a_span)
    monkeypatch.setattr(repair, "FAN_IN", fan_in)
    spans, verdicts = repair.parse(conversations(spark, talk), copies=F.col("copies"))
    got = {r[0]: tuple(r[1:]) for r in repair.digest(spans, verdicts).collect()}
    assert got == expected(talk)
    order = {}
    for r in repair.repaired_turns(spans).orderBy("conv_id", "part", "span", "place").collect():
        order.setdefault(r.conv_id, []).append(r.role[:1])
    assert all(re.fullmatch("(s?(ua)+)?", "".join(roles)) for roles in order.values()) and len(order[99]) == 50


def test_no_conversations(spark):
    assert repair.digest(*repair.parse(conversations(spark, []))).collect() == []


def test_cells_do_not_depend_on_the_split():
    draw = random.Random(5)
    leaves = [draw.choice([*repair.LEAVES.values(), repair.deleted(1)]) for _ in range(12)]
    whole = repair.parsed(leaves)
    for cut in range(1, 12):
        assert repair.combined(repair.parsed(leaves[:cut]), repair.parsed(leaves[cut:])) == whole


def test_damage_follows_the_number_of_the_row(spark):
    rows = [(c, t, "assistant", "One. Two!", 1) for c in [None, *range(30)] for t in [None, 0, 1]]
    hurt, _ = repair.damage(conversations(spark, rows))
    for r in hurt.collect():
        key = f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}"
        fault = zlib.crc32(key.encode()) % 20
        want = ("user" if fault == 4 else "assistant", {1: "", 2: "One Two"}.get(fault, "One. Two!"), {0: 0, 3: 2}.get(fault, 1))
        assert (r.role, r.text, r.copies) == want


# --- fingerprints ------------------------------------------------------------------------------------------------------

def fingerprint(text):
    words = WORDS.findall(ascii_lower(text or ""))
    votes = [0] * 64
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def reached(prints, budget=4):
    """The smallest place that each place reaches over pairs within the budget."""
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= budget
    label = np.arange(len(prints))
    while True:
        lower = np.array([label[near[i]].min() for i in range(len(prints))])
        if (lower == label).all():
            return label
        label = lower


def scattered(seed, n=60):
    """Fingerprints and copies of them with a few changed bits, in dense groups."""
    draw = np.random.default_rng(seed)
    out = list(draw.integers(0, 2 ** 64, n, dtype=np.uint64))
    for x in out[:n // 3]:
        for _ in range(int(draw.integers(1, 30))):
            bits = draw.choice(64, int(draw.integers(0, 8)), replace=False)
            out.append(x ^ np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64)) if len(bits) else x)
    return np.unique(np.array(out, dtype=np.uint64))


@pytest.mark.parametrize("seed", range(8))
def test_the_two_walks_find_all_links(seed):
    prints = scattered(seed)
    first = trie.walked(prints, prints.copy(), 0, 0, 0, 4)
    turned = trie.exchanged(prints)
    order = np.argsort(turned)
    second = np.empty_like(prints)
    second[order] = trie.walked(turned[order], first[order], 0, 0, 0, 4)
    want = reached(prints)
    assert {tuple(np.flatnonzero(second == x)) for x in set(second)} == {tuple(np.flatnonzero(want == x)) for x in set(want)}


@pytest.mark.parametrize("unit", [4, 1 << 19])
def test_classes_over_subtrees(spark, monkeypatch, unit):
    monkeypatch.setattr(trie, "SPREAD", 1 << 20)  # so that the unit is the limit
    monkeypatch.setattr(trie, "LEAST_LEAVES", 1)
    prints = scattered(21)
    frame = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    got = {r.fp: r.label for r in trie.classes(frame, unit=unit).collect()}
    label = np.array([got.get(int(x), int(x)) for x in prints.view(np.int64)])
    want = reached(prints)
    assert {tuple(np.flatnonzero(label == x)) for x in set(label)} == {tuple(np.flatnonzero(want == x)) for x in set(want)}


def test_a_group_of_near_copies_leaves_a_row_a_leaf():
    """All fingerprints with two of forty bits set: every pair is within four bits, and no list of pairs comes out."""
    prints = np.unique(np.array([1 << i | 1 << j for i in range(40) for j in range(i)], dtype=np.uint64))
    labels = trie.walked(prints, prints.copy(), 0, 0, 0, 4)
    assert len(set(labels)) == 1 and len(labels) == 780


def test_documents_by_fingerprint(spark):
    base = sentence(*range(400, 520))
    rows = [*EDGE, (20, base), (21, base.replace("word450", "other")), (22, base.upper()), (23, base + "\n"), (24, "\x00   x")]
    prints = np.array([fingerprint(t) for _, t in rows], dtype=np.uint64)
    label = reached(prints)
    least = {k: min((rows[i][0] for i in np.flatnonzero(label == k) if rows[i][0] is not None), default=None) for k in set(label)}
    want = sorted(((i, f"{int(p):016x}", least[k]) for (i, _), p, k in zip(rows, prints, label)), key=repr)
    verdicts = trie.judge_documents(documents(spark, rows))
    assert sorted(map(tuple, verdicts.collect()), key=repr) == want
    kept = trie.keep_first(documents(spark, rows), verdicts)
    assert sorted({r.doc_id for r in kept.collect() if r.doc_id is not None}) == sorted({x for x in least.values() if x is not None})
    assert trie.judge_documents(documents(spark, [])).collect() == []


# --- resampling --------------------------------------------------------------------------------------------------------

TOKENS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = TOKENS.findall(ascii_lower(text or ""))
    return words, [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def resampled(rows, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (big_s + 10_000) / ((s[k] + 1) * (big_t + 10_000)))) for k in range(10_000)]
    out = []
    for i, text in rows:
        words, found = features(text)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    enough = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(enough[:5 * len(enough) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_hashes_of_byte_ranges():
    draw = np.random.default_rng(2)
    buffer = draw.bytes(6_000)
    starts, sizes = draw.integers(0, 5_000, 4_000), np.concatenate([draw.integers(1, 40, 3_000), draw.integers(1, 900, 1_000)])
    pieces = [buffer[a:a + n] for a, n in zip(starts, sizes)]
    assert resampling.xxh64(buffer, resampling.eights(buffer), starts, sizes).tolist() == [xxhash.xxh64_intdigest(p) for p in pieces]
    assert resampling.crc32(buffer, starts, sizes).tolist() == [zlib.crc32(p) for p in pieces]


@pytest.mark.parametrize("hashed", [None, 0, 7])
def test_interned_features(monkeypatch, hashed):
    """Also when all keys are equal, or only few differ, so that bytes alone tell features apart."""
    texts = ["One two, one TWO three", None, "", "Été été 99 a-b " + "long" * 30, "one two " * 40, "x" * 300 + " y"]
    if hashed is not None:
        monkeypatch.setattr(resampling, "xxh64", lambda b, at, starts, sizes: (sizes % (hashed + 1)).astype(np.uint64))
    found = resampling.Occurrences([None if t is None else t.encode() for t in texts])
    table = resampling.InternTable(found)
    names = [found.buffer[a:b].decode() for a, b in zip(found.starts, found.ends)]
    want = [features(t)[1] for t in texts]
    assert sorted(names) == sorted(f for fs in want for f in fs)
    assert {s: {n for n, x in zip(names, table.slot) if x == s} for s in set(table.slot)} == {
        s: {next(n for n, x in zip(names, table.slot) if x == s)} for s in set(table.slot)}
    assert len(set(table.slot)) == len(set(names)) == len(table.used)
    assert {names[table.first[s]]: (table.bucket[s], table.count[s]) for s in table.used} == {
        n: (zlib.crc32(n.encode()) % 10_000, k) for n, k in Counter(names).items()}
    assert np.bincount(found.owner, minlength=len(texts)).tolist() == [len(f) for f in want]


def test_drawn_documents(spark):
    draw = random.Random(11)
    rows = [*EDGE, *((100 + i, sentence(*(draw.randrange(300) for _ in range(draw.randrange(60))))) for i in range(300)),
            (500, "Élément " * 30), (501, "Élément " * 30)]
    target = [sentence(*range(40)), None, "", sentence(*range(250, 290))]
    docs = documents(spark, rows)
    items = spark.createDataFrame([(str(i), t, "x") for i, t in enumerate(target)], "item_id string, text string, weight string")
    got = resampling.resample(docs, items)
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == resampled(rows, target)
    assert resampling.drawn_documents(docs, got).count() == got.filter("rank is not null").count() == 5 * got.filter("n_words >= 20").count() // 100
    assert resampling.resample(documents(spark, []), items).collect() == []
    alike = resampling.resample(docs, items.limit(0)).select(*columns)
    assert sorted((tuple(r) for r in alike.collect()), key=repr) == resampled(rows, [])


# --- near copies of the n-gram join --------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [100, 300])
def test_a_group_of_near_copies_leaves_few_open_pairs(spark, monkeypatch, n):
    """Copies of one text with one to four changed words: many pairs just fail, and few of them may be looked at."""
    draw = random.Random(1)
    texts = []
    for _ in range(n):
        words = [f"w{i}" for i in range(200)]
        for place in draw.sample(range(200), draw.randrange(1, 5)):
            words[place] = f"x{draw.randrange(10 ** 9)}"
        texts.append(" ".join(words))
    counted, plain = {}, ngram_jaccard.stored

    def counting(df, name):
        out = plain(df, name)
        counted[name] = counted.get(name, 0) + (out.count() if name in ("class-partners", "open-pairs") else 0)
        return out

    monkeypatch.setattr(ngram_jaccard, "stored", counting)
    got = {r.doc_id: r.component_id for r in ngram_jaccard.judge_documents(documents(spark, list(enumerate(texts)))).collect()}
    sets = [{" ".join(t.split()[k:k + 5]) for k in range(196)} for t in texts]
    label = list(range(n))
    for a in range(n):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert got == dict(enumerate(label))
    assert counted["class-partners"] + counted["open-pairs"] < 4 * n


def test_a_repeated_attempt_leaves_one_array_file(tmp_path):
    import numpy as np

    from cropline.llm.common import map_array, put_array

    for _ in range(2):
        put_array(f"file://{tmp_path}/part/a.npy", np.arange(5))
    assert [f.name for f in (tmp_path / "part").iterdir()] == ["a.npy"]
    assert map_array(f"file://{tmp_path}/part/a.npy").tolist() == list(range(5))


def test_turns_end_where_few_link(spark, monkeypatch):
    draw, base, texts = random.Random(7), [f"word{k}" for k in range(200)], []
    for _ in range(120):
        words = list(base)
        for place in draw.sample(range(200), draw.randint(1, 4)):
            words[place] = f"x{draw.randrange(10 ** 9)}"
        texts.append(" ".join(words))
    docs = documents(spark, list(enumerate(texts)))
    turns, partners = [], ngram_jaccard.class_partners
    monkeypatch.setattr(ngram_jaccard, "SHARE", 1, raising=False)
    monkeypatch.setattr(ngram_jaccard, "TRIES", 1)
    monkeypatch.setattr(ngram_jaccard, "class_partners", lambda placed, turn: turns.append(turn) or partners(placed, turn))
    got = {r.doc_id: r.component_id for r in ngram_jaccard.judge_documents(docs).collect()}
    sets = [{" ".join(t.split()[k:k + 5]) for k in range(196)} for t in texts]
    label = list(range(120))
    for a in range(120):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert got == dict(enumerate(label))
    assert turns == [0, 1]  # the second one links a few, and a third would pass over all columns for them
