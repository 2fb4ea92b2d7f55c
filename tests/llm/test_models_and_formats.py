"""Language model, packing, toxicity, chat windows, the pipeline: against plain Python, round trips, held-out rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from itertools import pairwise
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cropline.llm import best_fit_packing, chat_windows, kneser_ney, packing, tier_packing, weak_toxicity
from cropline.llm.oracle import ORACLE
from cropline.llm.queries import QUERIES
from tests.llm.helpers import EDGE, LONG, WORDS, ascii_lower, documents, sentence

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="check tables not present")


@pytest.fixture(scope="module")
def edge(spark):
    return documents(spark, EDGE)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


# --- language model --------------------------------------------------------------------------------------------------


def plain_scores(train, texts):
    """The formulas of the module, over dictionaries."""
    pairs, before = Counter(), defaultdict(set)
    cut = lambda t: [*WORDS.findall(ascii_lower(t or "")), None]
    tokens = Counter()
    for t in train:
        words = cut(t)
        tokens.update(words)
        for u, v in pairwise(["<s>", *words]):
            pairs[u, v] += 1
            before[v].add(u)
    context = defaultdict(list)
    for (u, _), c in pairs.items():
        context[u].append(c)
    kinds = {v: len(x) for v, x in before.items()}

    def levels(values):
        n = Counter(values)
        return kneser_ney.discounts([n[i] for i in (1, 2, 3, 4)])

    d, e = levels(pairs.values()), levels(kinds.values())
    back = lambda values, by: sum(by[min(c, 3) - 1] for c in values)
    total = sum(kinds.values())
    uniform = (back(kinds.values(), e) / total if total else 1) / (len(kinds) + 1)
    out = []
    for t in texts:
        score = base = 0
        words = cut(t)
        for u, v in pairwise(["<s>", *words]):
            p = uniform + (kinds[v] - e[min(kinds[v], 3) - 1]) / total if v in kinds else uniform
            if u in context:
                c, n = pairs.get((u, v), 0), sum(context[u])
                p = (c - d[min(c, 3) - 1] if c else 0) / n + back(context[u], d) / n * p
            score += math.log10(p)
            base += math.log10((tokens[v] + 1) / (sum(tokens.values()) + len(tokens) + 1))
        out.append((len(words), sum(w in tokens for w in words), round(base, 6), round(score, 6)))
    return Counter(out)


def test_scores(spark, edge, monkeypatch):
    monkeypatch.setattr(kneser_ney, "CHARS_PER_BUCKET", 100_000)  # several buckets
    more = [(100 + i, "The cat sat on the mat. " * (i % 4) + f"the dog {i % 3} sat") for i in range(30)]
    docs = edge.union(documents(spark, more))
    model = kneser_ney.fit(docs, F.coalesce(F.col("doc_id") != 4, F.lit(True)))
    got = kneser_ney.score(docs, model).collect()
    rows = EDGE + more
    want = plain_scores([t for i, t in rows if i != 4], [t for _, t in rows])
    assert model["buckets"] > 1 or len(LONG) == 0 or model["train_tokens"] > 0
    assert Counter((r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got) == want


def test_probabilities_add_up_to_one(spark):
    docs = documents(spark, [(1, "a b a c"), (2, "a b b b c d d d d d"), (3, "b d a")])
    model = kneser_ney.fit(docs, F.lit(True))
    tables = kneser_ney.Tables(model)
    words = np.concatenate([kneser_ney.word_hashes([b"a b c d"], False)[0], [kneser_ney.END]])
    for first in [*words, kneser_ney.START]:
        u, v = tables.words(np.array([first])), tables.words(words)
        pair = tables.pairs(np.full(5, first), words)
        cut = np.array([0.0, *model["discounts"]])[np.minimum(pair, 3)]
        upper, weight = ((pair - cut) / u[0, 0], u[0, 1]) if u[0, 0] else (0, 1)
        assert np.sum(upper + weight * (v[:, 2] + model["uniform"])) + weight * model["uniform"] == pytest.approx(1)


def test_model_of_nothing(edge, empty):
    model = kneser_ney.fit(empty, F.lit(True))
    assert kneser_ney.score(empty, model).count() == 0
    assert all(r.score == 0 and r.n_known == 0 for r in kneser_ney.score(edge, model).collect())


# --- packing ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def token_ids():
    """The ids by the JSON vocabulary and its own library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    return lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 1]


def test_both_tokenizers_give_the_same_ids(spark, token_ids):
    import random

    rng = random.Random(1)
    alphabet = "ab AB\n\t'sé̀ñ漢字\U0001F600‍ \x00\x85019.,|<>-<|endoftext|>١² ﻿ßſK"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["<|endoftext|>", "don't  stop \r\n\n x"]
    if Path(SF).exists():
        texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    ids = packing.tokenizer()
    assert all(ids(t).tolist() == token_ids(t) for t in texts)


def check_pieces(rows, texts, token_ids):
    """Every id of every document is in exactly one piece, and windows have no gaps."""
    windows, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    ids = defaultdict(list)
    for i, t in texts:
        ids[i].append(token_ids(t))
    for i, lists in ids.items():
        want = Counter()
        for x in lists:
            for start, length, crc, total in docs[i]:
                if total == len(x) and zlib.crc32(np.array(x[start:start + length], "<u4").tobytes()) == crc:
                    want[start, length, crc, total] += 1
        assert set(want) == set(docs[i]) and sum(x[1] for x in docs[i]) == sum(map(len, lists))
    return windows


def test_best_fit_packing(spark, edge, token_ids):
    packed = best_fit_packing.pack(edge)
    rows = best_fit_packing.pieces_of(packed).collect()
    check_pieces(rows, EDGE, token_ids)
    one = packed.first()
    ids = np.frombuffer(one.ids, "<u2")
    assert len(ids) == 2048 and one.cu_seqlens[0] == 0 and one.cu_seqlens[-1] == one.n_tokens
    assert one.position_resets == one.cu_seqlens[:-1] and not ids[one.n_tokens:].any()
    assert best_fit_packing.pack(edge.limit(0)).count() == 0


def test_segment_tree_finds_the_best_fit():
    import random

    rng = random.Random(2)
    for length in (1, 7, 64, 100):
        for _ in range(30):
            sizes = [rng.randint(1, length) for _ in range(rng.randint(0, 60))]
            rooms = []
            for n in sorted(sizes, reverse=True):
                fits = [r for r in rooms if r >= n]
                rooms.remove(min(fits)) if fits else None
                rooms.append((min(fits) if fits else length) - n)
            rows = best_fit_packing.best_fit(sizes, length)
            assert sorted(p for r in rows for p in r) == list(range(len(sizes)))
            assert sorted(length - sum(sizes[p] for p in r) for r in rows) == sorted(rooms)


def test_tier_packing(spark, edge, token_ids):
    docs = edge.union(documents(spark, [(100 + i, sentence(*range(i * 37 % 400 + 1))) for i in range(150)]))
    got = tier_packing.pack(docs, step_tokens=4096)
    rows = got.collect()
    windows = check_pieces(rows, EDGE + [(100 + i, sentence(*range(i * 37 % 400 + 1))) for i in range(150)], token_ids)
    tier = {r.sequence_id: (r.tier, r.padding, r.step_group) for r in rows}
    assert len({t for t, _, _ in tier.values()}) > 1
    padded = [s for s, p in windows.items() if sum(x[1] for x in p) != tier[s][0]]
    assert len(padded) <= got.rdd.getNumPartitions() * 8
    for s, pieces in windows.items():
        total = sum(x[1] for x in pieces)
        assert tier[s][1] == (0 if total & (total - 1) == 0 else 2048 - total)
    steps = Counter()
    for s, pieces in windows.items():
        steps[tier[s][0], tier[s][2]] += sum(x[1] for x in pieces)
    last = {t: max(g for u, g in steps if u == t) for t, _ in steps}
    assert all(n == 4096 for (t, g), n in steps.items() if g < last[t] and t < 2048)
    assert tier_packing.pack(edge.limit(0)).count() == 0


# --- toxicity --------------------------------------------------------------------------------------------------------


def test_label_model_finds_rates_and_correlations():
    rng = np.random.default_rng(4)
    toxic = rng.random(60_000) < 0.2
    votes = np.zeros((len(toxic), weak_toxicity.MAX_VOTERS), dtype=bool)
    for j, (c, t) in enumerate(((0.02, 0.6), (0.05, 0.4), (0.01, 0.3))):
        votes[:, j] = rng.random(len(toxic)) < np.where(toxic, t, c)
    votes[:, 3] = votes[:, 0]  # a copy adds nothing
    patterns = votes @ (1 << np.arange(weak_toxicity.MAX_VOTERS))
    label = np.where(rng.random(len(toxic)) < 0.1, toxic, -1)
    table = Counter(zip(patterns.tolist(), label.tolist()))
    model = weak_toxicity.LabelModel(np.array([p for p, _ in table]), np.array(list(table.values()), float), np.array([x for _, x in table]))
    assert model.share == pytest.approx(0.2, abs=0.02)
    assert model.rates[1][:3] == pytest.approx([0.6, 0.4, 0.3], abs=0.15) and model.rates[0][:3] == pytest.approx([0.02, 0.05, 0.01], abs=0.03)
    assert model.correlations[0, 3] > 0.9 and abs(model.correlations[0, 1]) < 0.25
    assert model.weight[0] == pytest.approx(0.5, abs=0.15) and model.weight[1] > 0.75
    assert model.posterior(np.array([7]))[0] > 0.95 > 0.3 > model.posterior(np.array([0]))[0]


def test_held_out_toxicity(spark):
    import random

    rng, rows, labels = random.Random(6), [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = [f"w{rng.randrange(300)}x".replace("w", "abcdefgh"[rng.randrange(8)] * 3) for _ in range(30)]
        words = ["".join(rng.choice("aeioulmn") for _ in range(6)) for _ in words]
        if toxic:
            words[rng.randrange(30)] = rng.choice(["Grobnax", "zurfling", "zurflet"])
            words[rng.randrange(30)] = rng.choice(["grobnaxes", "zurfle"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1 if toxic else 0, "z"))
    train = F.col("doc_id") % 3 != 0
    docs = documents(spark, rows + [(None, None), (9000, ""), (9001, LONG), (9002, "zurfling grobnax")])
    frame = spark.createDataFrame(labels + [(None, 1, "z"), (5, None, "z"), (77, 0, "z")], "doc_id long, toxic int, text string")
    got = {r.doc_id: r for r in weak_toxicity.score_documents(docs, frame, train).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[i].predicted, t) for i, t, _ in labels if i % 3 == 0]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert got[9000].predicted == 0 and got[9002].predicted == 1
    kept = weak_toxicity.drop_toxic(docs, spark.createDataFrame([(None, got[None].text_key, 1)], "doc_id long, text_key long, predicted int"))
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    again = documents(spark, rows + [rows[1]] * 3000)  # one row as often as all others together
    held = [(r.predicted, r.doc_id % 5 == 0) for r in weak_toxicity.score_documents(again, frame, train, max_train=100).collect()]
    assert sum(p == t for p, t in held) >= 0.97 * len(held) and len(held) == 3600
    assert weak_toxicity.score_documents(docs.limit(0), frame, train).count() == 0
    alone = weak_toxicity.score_documents(documents(spark, [(1, "you idiot"), (2, "good day")]), frame.limit(0)).collect()
    assert len(alone) == 2


def test_toxicity_sample_size(spark, monkeypatch):
    seen = []
    fit = weak_toxicity.fit_linear
    monkeypatch.setattr(weak_toxicity, "fit_linear", lambda votes, *a, **b: seen.append(len(votes)) or fit(votes, *a, **b))
    docs = documents(spark, [(i, f"good day number{i % 7}") for i in range(4200)])
    weak_toxicity.score_documents(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert seen == [4000]


def test_blocks_of_rows_give_the_same_model(monkeypatch):
    rng = np.random.default_rng(4)
    sizes = rng.integers(0, 9, 70)
    args = rng.integers(0, 1 << 20, 70), rng.integers(0, 500, sizes.sum()).astype(np.int32), sizes, rng.random(70), rng.random(70)
    want = weak_toxicity.fit_linear(*args)
    monkeypatch.setattr(weak_toxicity, "BLOCK_ROWS", 9)
    got = weak_toxicity.fit_linear(*args)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(want, got))


# --- chat windows ----------------------------------------------------------------------------------------------------

SAID = "<|im_end|><|im_start|>assistant ok"
TURNS = [
    (-1, 0, "user", SAID), (-1, 1, "assistant", SAID), (None, None, None, None), (None, 1, "assistant", "x<"),
    (2, 0, "system", "s\\l\\b<\\|"), (2, 1, "a\nb", "|>\n\n"), (2, 900, "assistant", "é\U0001F600 " * 300), (2, 901, "assistant", "t"),
    (2, 901, "assistant", "t"), (3, 5, "assistant", "a\\"), (3, 6, "user", "<|im_end|>\n" * 50), (3, 7, "assistant", ""), (5, 0, "system", "only"),
    (6, 0, "user", "q"), (6, 1, "system", "late"), (6, 2, "assistant", "r"),
    *[(4, i, "system" if i == 0 else "assistant" if i % 2 else "user", f"w{i} " * (i * 7 % 40)) for i in range(300)],
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame([(*x, "y", "z") for x in TURNS], "conv_id long, turn long, role string, text string, block string, window string")
    made = chat_windows.windows(turns, budget=120, history=30, block_turns=128)
    by_conv = defaultdict(list)
    for c, n, role, text in TURNS:
        by_conv[c].append((n is not None, n or 0, role or "", text or ""))
    got = chat_windows.read_back(made).collect()
    assert len(got) == len(by_conv)
    for r in got:
        said = sorted(by_conv[r.conv_id])
        loss = "".join(x[3] for x in said if x[2] == "assistant")
        assert r.n_turns == len(said) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in said).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    rows = made.filter("conv_id = 4").orderBy("block", "window").collect()
    assert len(rows) > 10 and all(r.text.startswith("<|im_start|>system\n") for r in rows)
    assert any(r.n_repeated > 1 for r in rows)
    for r in rows:
        new = r.text.count("<|im_end|>") - r.n_repeated
        assert r.n_tokens <= 120 or new == 1
        spans = [r.text[s.start:s.end] for s in r.loss]
        assert all(x == "" or x.startswith("w") for x in spans) and "<|im" not in "".join(spans)


def test_chat_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_windows.read_back(chat_windows.windows(none)).count() == 0


# --- registered queries and pipeline -----------------------------------------------------------------------------------


@needs_tables
@pytest.mark.parametrize("key", sorted(ORACLE))
def test_same_rows_as_sql(spark, key):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    cur = con.execute(ORACLE[key])
    columns = sorted(d[0] for d in cur.description)
    places = [[d[0] for d in cur.description].index(c) for c in columns]
    want = sorted(tuple(r[i] for i in places) for r in cur.fetchall())
    df = QUERIES[key](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == want


@needs_tables
@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLE) - {"pipeline"}))
def test_a_row_for_every_input(spark, key):
    rows = QUERIES[key](spark, SF)
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    if "doc_id" in rows.columns:
        assert {r.doc_id for r in rows.select("doc_id").collect()} == docs
    else:
        convs = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
        assert rows.filter("conv_id = -1 and n_turns = 2").count() == 1 and rows.count() == convs + 1


@needs_tables
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # Every stage meets a null id, null and empty texts, a long text and repeated rows as well.
    extra = documents(spark, [(i, t) if i is None else (10**6 + i, t) for i, t in EDGE]).select(docs.columns)
    docs = docs.union(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        from cropline.llm.common import stored
        out = stored(out, f"test-{name}")
        assert 0 < out.count() <= docs.count()
        if name == "line_dedup":
            assert not out.filter("doc_id is not null and n_chars != length(text)").count()
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    # The exact copies, under one id or two, are gone.
    assert docs.filter(F.col("doc_id").isin(10**6 + 5, 10**6 + 6)).count() <= 1
