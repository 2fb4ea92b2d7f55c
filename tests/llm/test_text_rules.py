"""Line frequency, decontamination, personal data, line edits, Jaccard links: against plain Python."""

import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cropline.llm import decontaminate, line_edit_join, line_frequency, ngram_jaccard, pii_bootstrap
from tests.llm.helpers import CLASHES, EDGE, LONG, WORDS, ascii_lower, documents, sentence


@pytest.fixture(scope="module")
def edge(spark):
    return documents(spark, EDGE)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


# --- line frequency --------------------------------------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {p for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for p in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_counts_and_boilerplate(spark, edge):
    shared = "All rights reserved 2024, see the terms"
    own = [(100 + i, sentence(*range(i * 50, i * 50 + 30)) + "\n" + shared.replace("2024", str(2000 + i))) for i in range(6)]
    only = [(200, shared), (201, shared + "\n" + sentence(1, 2))]
    docs = edge.union(documents(spark, own + only))
    got = line_frequency.judge_documents(docs)
    rows = got.collect()
    assert len(rows) == docs.count()
    texts = defaultdict(set)
    for r in docs.collect():
        texts[r.doc_id].add(r.text)
    for r in rows:
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert counts in {plain_counts(t) for t in texts[r.doc_id]}, r.doc_id
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    by_id = {r.doc_id: r for r in rows}
    # The line differs in its year only, which is normalised away: eight documents have it.
    assert all(by_id[100 + i].removed_lines == [1] and by_id[100 + i].kept for i in range(6))
    assert by_id[200].base_failed and not by_id[201].kept
    cleaned = {r.doc_id: r for r in line_frequency.clean_texts(docs, got).collect()}
    assert cleaned[100].text == own[0][1].split("\n")[0] and cleaned[100].text_key == "x" and 201 not in cleaned


def test_repeated_rows_are_one_document(spark):
    line = sentence(*range(20))
    assert all(r.kept for r in line_frequency.judge_documents(documents(spark, [(1, line)] * 9)).collect())


def test_line_frequency_of_nothing(empty):
    assert line_frequency.judge_documents(empty).count() == 0


# --- decontamination -------------------------------------------------------------------------------------------------


def plain_hits(docs, items):
    out = Counter()
    for doc_id, text in docs:
        words, hit, found = tokens(text), set(), set()
        for item_id, item in items:
            part = tokens(item)
            size = min(13, len(part))
            for k in range(len(part) - size + 1 if part else 0):
                for i in range(len(words) - size + 1):
                    if words[i:i + size] == part[k:k + size]:
                        hit |= set(range(i, i + size))
                        found.add(str(item_id).replace("None", "null"))
        out[(doc_id, len(words), len(hit), tuple(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(words))] += 1
    return out


def test_benchmark_hits(spark, edge):
    items = [(1, sentence(*range(10, 30))), (2, "One, TWO"), (3, None), (4, ""), (2, "one two"), (None, "É\U0001F600"),
             (5, sentence(*range(10, 30))), (6, "a b c"), (7, sentence(*range(500, 513)))]
    benchmark = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, gram string")
    got = decontaminate.judge_documents(edge, benchmark)
    rows = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got.collect())
    assert rows == plain_hits(EDGE, items)
    kept = decontaminate.remove_contaminated(edge, benchmark, got)
    assert kept.columns == edge.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 3, 4} and not kept.filter("doc_id in (5, 6, 9, 10)").count()
    cut = decontaminate.remove_spans(edge, got).filter("doc_id = 9 or doc_id = 3").collect()
    assert {r.doc_id: r.text for r in cut} == {9: "", 3: EDGE[2][1]}


def test_decontamination_of_nothing(spark, edge, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.judge_documents(edge, none).agg(F.max("n_hit"), F.count("*")).first()[:] == (0, len(EDGE))
    assert decontaminate.judge_documents(empty, none).count() == 0


def test_shuffled_hash_set_gives_the_same(spark, edge, monkeypatch):
    benchmark = spark.createDataFrame([(1, sentence(*range(10, 30)))], "item_id long, text string")
    want = sorted(map(str, decontaminate.judge_documents(edge, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted(map(str, decontaminate.judge_documents(edge, benchmark).collect())) == want


# --- personal data ---------------------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans(spark, edge):
    more = [(50, "a@b.c_x@d.e a@b.c"), (51, "1.2.3.4.5.6.7.8 300.1.1.1 0000255.1.1.01 1.2.3"), (52, "é\U0001F600 x@y.z 4111 1111 1111 1111-4111111111111111"),
            (53, "+1 (777) 555-7427 +12 +1...9999999999"), (54, "9" * 5000), (55, "a" * 20_000 + "@"), (56, "4111111111111111 4111111111111112"),
            (50, "a@b.c_x@d.e a@b.c")]
    docs = edge.union(documents(spark, more))
    got = pii_bootstrap.find_spans(docs)
    rows = got.select("doc_id", pii_bootstrap.listed(F.col("base")).alias("b"), pii_bootstrap.listed(F.col("spans")).alias("s")).collect()
    assert Counter((r.doc_id, r.b) for r in rows) == Counter((i, plain_spans(t)) for i, t in EDGE + more)
    masked = {r.doc_id: r.text for r in pii_bootstrap.mask(docs, got).collect()}
    assert masked[50] == "[email][email] [email]" and masked[9] == "one two"


def test_contexts_find_new_identifiers(spark):
    filler = "nothing of note here"
    rows = [(i, f"{filler} my badge mail is u{i}@site{i}.org and more") for i in range(12)]
    rows += [(100, f"{filler} my badge mail is UX-7741 and more"), (101, f"{filler} in year 1987 and more"), (102, f"{filler} mail was 77-21")]
    got = {r.doc_id: r.spans for r in pii_bootstrap.find_spans(documents(spark, rows)).collect()}
    text = rows[12][1]
    assert [(s.kind, text[s.start:s.end]) for s in got[100]] == [("email", "UX-7741")]
    assert not got[101] and not got[102] and len(got[3]) == 1


def test_personal_data_of_nothing(empty):
    assert pii_bootstrap.find_spans(empty).count() == 0


# --- line edits ------------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def test_banded_distance(spark):
    import random

    rng, rows = random.Random(5), []
    for _ in range(1500):
        k = rng.choice([1, 2, 3])
        a = [rng.choice("ab\U0001F600") for _ in range(rng.randint(k + 1, 16))]
        b = list(a)
        for _ in range(rng.randint(0, k + 2)):
            i = rng.randrange(len(b) + 1)
            b[i:i + rng.randint(0, 1)] = [rng.choice("abc")] * rng.randint(0, 1)
        a, b = sorted(("".join(a), "".join(b)), key=len, reverse=True)
        if len(a) - len(b) <= k < len(a):
            rows.append((k, a, b, distance(a, b)))
    df = spark.createDataFrame(rows, "k int, a string, b string, d int")
    for k in (1, 2, 3):
        found = df.filter(F.col("k") == k).select("d", line_edit_join.banded_distance(F.col("a"), F.col("b"), k).alias("got")).collect()
        assert all((r.got == r.d) if r.d <= k else (r.got > k) for r in found)


def plain_lines(rows, edits=2, least=24):
    places, parent = {}, {}
    for i, t in {(i, t) for i, t in rows if t is not None}:
        for no, x in enumerate(t.split("\n")):
            if len(x.strip(" \t\r")) >= least:
                places.setdefault(x.strip(" \t\r"), []).append((i is not None, i or 0, t, no))
    near = [(a, b) for a, b in combinations(places, 2) if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits]
    find = lambda x: x if parent.get(x, x) == x else find(parent[x])
    for a, b in near:
        parent[find(a)] = find(b)
    classes = defaultdict(list)
    for x, where in places.items():
        classes[find(x)] += where
    return sum(len(w) - 1 for w in classes.values()), Counter(x for p in near for x in p)


def test_near_lines(spark, edge):
    base = "The quick brown fox jumps over the lazy dog"
    variants = [base, base + "s", base.replace("brown", "brwn"), base.replace("lazy", "hazy") + "!", "Thx quick bown fxx jumps over the lzy dog",
                base + "sss", "\U0001F600" + base[1:], " " + base + "\r", base[:20]]
    rows = EDGE + [(50 + i, f"{v}\n{sentence(i * 1000, i * 1000 + 7, i + 5000)} {'pad' * 5}") for i, v in enumerate(variants)]
    docs = documents(spark, rows)
    got = line_edit_join.judge_lines(docs)
    removed, links = plain_lines([(i, t) for i, t in rows if t != LONG] + [(4, LONG)])
    found = got.collect()
    assert sum(r.removed for r in {(r.doc_id, r.text_key, r.line_no): r for r in found}.values()) == removed
    assert {r.doc_id: r.n_links for r in found if r.line_no == 0 and r.doc_id and 50 <= r.doc_id < 58} == {
        50 + i: links[v.strip(" \r")] for i, v in enumerate(variants[:8])}
    kept = line_edit_join.remove_lines(docs, got)
    assert kept.columns == docs.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[50] == rows[len(EDGE)][1] and texts[51].startswith("word") and 6 not in texts and texts[3] == EDGE[2][1]


def test_hot_segment_and_shuffled_keys(spark, monkeypatch):
    rows = [(i, f"the same long beginning of very many lines {i:04d}") for i in range(120)]
    want = sorted(map(str, line_edit_join.judge_lines(documents(spark, rows)).collect()))
    monkeypatch.setattr(line_edit_join, "SPLIT", 7)
    monkeypatch.setattr(line_edit_join, "BROADCAST_KEYS", 0)
    got = line_edit_join.judge_lines(documents(spark, rows)).collect()
    assert sorted(map(str, got)) == want
    lines = [t for _, t in rows]
    assert sum(r.n_links for r in got) == 2 * sum(distance(a[-4:], b[-4:]) <= 2 for a, b in combinations(lines, 2))


def test_edits_follow_the_length(spark):
    import random

    rng, lines = random.Random(8), []
    for n in [24, 100, 119, 120, 121, 124, 159, 160, 163, 200, 240, 300, 400, 800] * 2:
        base = [rng.choice("abcdefgh \U0001F600é") for _ in range(n)]
        base[0] = base[-1] = "x"
        lines.append(base)
        for edits in sorted({1, 2, 3, n // 40, n // 40 + 1, rng.randint(1, n // 20)}):
            copy = list(base)
            for i in rng.sample(range(1, n - 1), edits) if rng.random() < 0.5 else [n * (k + 1) // (edits + 1) - 1 for k in range(edits)]:
                copy[i] = rng.choice(["", "q", copy[i] + "q"])
            lines.append(copy)
    lines = sorted({"".join(x) for x in lines})
    limit = lambda n: n // 40 if n >= 120 else 2
    want = {(a, b) for a, b in combinations(lines, 2)
            if abs(len(a) - len(b)) <= limit(min(len(a), len(b))) and distance(a, b) <= limit(min(len(a), len(b)))}
    links = line_edit_join.line_links(documents(spark, list(enumerate(lines))), by_length=True).collect()
    keys = {r.k: r.line for r in spark.createDataFrame([(x,) for x in lines], "line string").select("line", F.xxhash64("line").alias("k")).collect()}
    assert sorted(tuple(sorted((keys[r.a], keys[r.b]))) for r in links) == sorted(want) and len(want) > 60


def test_marks_in_blocks_and_shares(spark, monkeypatch):
    import random

    rng, lines = random.Random(5), []
    for n in (130, 170, 420):
        base = [rng.choice("abcdefghij ") for _ in range(n - 2)]
        for _ in range(6):
            copy = ["x", *base, "y"]
            for i in rng.sample(range(1, n - 1), rng.randint(0, n // 60)):
                copy[i] = rng.choice("klm")
            lines.append("".join(copy))
    rows = list(enumerate(lines + lines[:3] + ["z" * 5000, "", None]))  # whole copies, a line that is too long, none
    want = {(a, b): distance(a, b) for a, b in combinations(sorted(set(lines)), 2)
            if len(a) == len(b) and distance(a, b) <= len(a) // 40}
    monkeypatch.setattr(line_edit_join, "MARKS_PER_BLOCK", 40)
    monkeypatch.setattr(line_edit_join, "HELD_MARKS", 30)
    monkeypatch.setattr(line_edit_join, "SPLIT", 2)
    monkeypatch.setattr(line_edit_join, "BROADCAST_KEYS", 0)
    docs = documents(spark, rows)
    keys = {r.line: r.k for r in docs.selectExpr("text line", "xxhash64(text) k").collect()}
    got = {frozenset((r.a, r.b)): r.distance for r in line_edit_join.long_links(docs).collect()}
    assert got == {frozenset((keys[a], keys[b])): d for (a, b), d in want.items()} and want


def test_long_lines_that_repeat_themselves(spark):
    import random

    rng, lines = random.Random(3), []
    for _ in range(4):
        base = "".join(rng.choice("abcdefghij") for _ in range(100))
        lines += [base * 3, (base[:50] + "x" + base[51:]) * 3]  # each mark at least twice in both
    links = line_edit_join.long_links(documents(spark, [(0, "\n".join(lines))])).collect()
    keys = [r.k for r in spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("k")).collect()]
    assert {frozenset((r.a, r.b)): r.distance for r in links} == {frozenset(keys[i:i + 2]): 3 for i in range(0, 8, 2)}


def test_lines_with_a_passage_in_common_do_not_meet(spark, monkeypatch):
    import random

    rng, seen, plain = random.Random(4), {}, line_edit_join.stored
    text = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n)).replace("  ", "ab")
    passage = text(60)
    lines = ["x" + text(250) + passage + text(250) + "y" for _ in range(30)]
    near = lines[0][:80] + "z" * 9 + lines[0][89:]
    far = lines[1][:80] + "z" * 40 + lines[1][120:]

    def kept(df, name):
        seen[name] = plain(df, name)
        return seen[name]

    monkeypatch.setattr(line_edit_join, "stored", kept)
    links = line_edit_join.long_links(documents(spark, list(enumerate([*lines, near, far])))).collect()
    assert [r.distance for r in links] == [distance(lines[0], near)]
    assert seen["long-pairs"].count() == 2  # not the 465 pairs that share the passage


def test_classes_of_long_lines_without_all_pairs(spark, monkeypatch):
    import random

    rng, lines = random.Random(11), []
    for letters in ("abcdefgh     ", "abcdefghijkl", "\u00e9\U0001F600xyz  ", "abcdefghij "):  # words, none, astral, long words
        for n in (120, 159, 200, 330, 480):
            base = [rng.choice(letters) for _ in range(n)]
            base[0] = base[-1] = "x"
            for _ in range(8):
                copy = list(base)
                for i in rng.sample(range(1, n - 1), rng.randint(0, n // 30)):
                    copy[i] = rng.choice(["", "q", copy[i] + " ", "q q"])
                lines.append("".join(copy))
    lines = sorted({x for x in lines if len(x) >= 120}) + ["ab " * 60 + "x", "ab " * 59 + "ac x", "z" * 300, "z" * 306]
    docs = documents(spark, list(enumerate(lines + lines[:5] + ["", None])))
    keys = {r.line: r.k for r in docs.selectExpr("text line", "xxhash64(text) k").collect()}
    limit = lambda a, b: min(len(a), len(b)) // 40
    want = {frozenset((keys[a], keys[b])) for a, b in combinations(lines, 2)
            if abs(len(a) - len(b)) <= limit(a, b) and distance(a, b) <= limit(a, b)}

    def classes(pairs):
        parent = {}
        find = lambda x: x if parent.get(x, x) == x else find(parent[x])
        for a, b in map(tuple, pairs):
            parent[find(a)] = find(b)
        found = defaultdict(set)
        for x in {x for p in pairs for x in p}:
            found[find(x)].add(x)
        return sorted(map(sorted, found.values()))

    for crowd, split in ((64, 500), (2, 5)):
        monkeypatch.setattr(line_edit_join, "CROWD", crowd)
        monkeypatch.setattr(line_edit_join, "SPLIT", split)
        got = [frozenset((r.a, r.b)) for r in line_edit_join.long_class_links(docs).collect()]
        assert set(got) <= want and classes(got) == classes(want) and len(want) > 40


def test_pairs_of_a_large_group_are_not_listed(spark, monkeypatch):
    import random

    rng, seen, plain = random.Random(12), Counter(), line_edit_join.stored
    base = [rng.choice("abcdefgh  ") for _ in range(300)]
    base[0] = base[-1] = "x"
    lines = set()
    while len(lines) < 120:
        copy = list(base)
        for i in rng.sample(range(1, 299), 3):
            copy[i] = rng.choice("klmnop")
        lines.add("".join(copy))

    def kept(df, name):
        out = plain(df, name)
        seen[name] += out.count()
        return out

    monkeypatch.setattr(line_edit_join, "stored", kept)
    judged = line_edit_join.judge_lines(documents(spark, list(enumerate(sorted(lines)))), by_length=True)
    assert judged.filter("removed").count() == 119  # 7,140 pairs are near
    assert seen["class-pairs"] + seen["long-pairs"] <= 120 * 2 * line_edit_join.TRIES


def test_long_lines_meet_at_marks_of_their_length(spark, monkeypatch):
    import random

    rng, seen, plain = random.Random(14), Counter(), line_edit_join.stored
    text = lambda n: "x" + "".join(rng.choice("abcdefghij klmnop") for _ in range(n - 2)) + "y"
    short, long, near = text(16).replace(" ", "q"), text(60), text(410)
    near = near[:396] + "mmmmmm" + near[402:]
    lines = [text(200) + " " + short + " " + text(200) for _ in range(6)]  # a passage of 20 code points
    lines += [text(n) + " " + long + " " + text(n) for n in (40, 100, 200, 400)]  # lengths that are far apart
    lines += [near, near[:100] + "z" * 10 + near[110:], near[:402], near[:398]]  # the last one is of another band

    def kept(df, name):
        out = plain(df, name)
        seen[name] += out.count()
        if name == "long-lines":
            seen["met"] = {r.line for r in out.select("line").collect()}
        return out

    monkeypatch.setattr(line_edit_join, "stored", kept)
    links = line_edit_join.long_class_links(documents(spark, list(enumerate(lines)))).collect()
    assert seen["met"] == set(lines[-4:]) and len({frozenset((r.a, r.b)) for r in links}) == 3


def test_bands_cover_what_near_lines_have_in_common(spark):
    low, high = line_edit_join.LONG_FROM, line_edit_join.LONG_TO + line_edit_join.LONG_TO // line_edit_join.EDIT_EVERY
    rows = spark.range(low, high + 1).select("id", line_edit_join.bands_of(F.col("id").cast("int")).alias("bands")).collect()
    bands = {r.id: {b.low: b.gram for b in r.bands} for r in rows}
    for n in range(low, line_edit_join.LONG_TO):
        edits = n // 40
        own = max(b for b in line_edit_join.BANDS if b <= n)
        piece = -(-(n - edits) // (edits + 1))  # of the shorter line, the longest one between its edits
        assert bands[n][own] + line_edit_join.REACH <= piece and all(own in bands[n + d] for d in range(edits + 1))
    assert min(min(x.values()) for x in bands.values() if x) == line_edit_join.GRAM


def test_marks_of_a_line_are_least_hashes_of_runs():
    import numpy as np

    lines = ["ab" * 80, "".join(chr(97 + i * i % 23) for i in range(140)), "\U0001F600" * 120]
    marks, owner = line_edit_join.mark_runs(lines)
    for i, line in enumerate(lines):
        alone, _ = line_edit_join.mark_runs([line])
        assert marks[owner == i].tolist() == alone.tolist()
        runs = [line_edit_join.mark_runs([line[k:k + 30]])[0].tolist() for k in range(len(line) - 29)]
        assert all(len(r) == 1 for r in runs) and [r[0] for k, r in enumerate(runs) if not k or r != runs[k - 1]] == alone.tolist()
    assert marks.dtype == np.uint64


def test_pipeline_removes_short_and_long_near_lines(spark):
    import corpus_pipeline

    words = [f"longer{i:03d}" for i in range(50)]
    other = " ".join(words[:20] + ["exchange"] + words[21:])
    rows = [(1, " ".join(words) + "\nAll rights reserved.\n--\none"), (2, other + "\n All rights reserved.\n--\ntwo"), (3, "ONE\n\none")]
    kept = corpus_pipeline.line_dedup(spark, documents(spark, rows), "")
    assert {r.doc_id: r.text for r in kept.collect()} == {1: rows[0][1], 2: "--\ntwo", 3: "ONE\n"}


def test_lines_of_nothing(empty):
    assert line_edit_join.judge_lines(empty).count() == 0


# --- Jaccard links ---------------------------------------------------------------------------------------------------


def plain_components(rows):
    sets = []
    for i, t in rows:
        w = WORDS.findall(ascii_lower(t or ""))
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    out = Counter()
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        out[(i, len(sets[a]), min(ids) if ids and sets[a] else i)] += 1
    return out


def test_components(spark):
    import random

    rng, rows = random.Random(3), list(EDGE)
    for g in range(6):  # near copies, chained and starred, around the limit
        words = [f"g{g}w{i}" for i in range(rng.choice([6, 30, 80]))]
        for c in range(8):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"x{rng.random()}"
            rows.append((1000 + 10 * g + c, " ".join(copy).title() if c == 3 else " ".join(copy)))
            words = copy if c % 3 == 0 else words
    passage = " ".join(f"p{i}" for i in range(60))  # shared by many, dominant in some
    rows += [(2000 + i, passage + " " + " ".join(f"o{i}n{k}" for k in range(5 * i))) for i in range(12)]
    docs = documents(spark, rows)
    got = ngram_jaccard.judge_documents(docs)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_components(rows)
    kept = ngram_jaccard.keep_first(docs, got)
    assert kept.columns == docs.columns and set(CLASHES) <= set(kept.columns)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(5) == 1 and 6 not in ids and {1, 2, 3, 4, 9} <= set(ids)


def test_one_stays_of_near_copies_without_an_id_or_with_the_same(spark):
    copies = lambda start: [sentence(*range(start, start + 60), *more) for more in ((), (1,), (2,))]
    rows = [(None, t) for t in copies(100)] + [(5, t) for t in copies(300)] + [(None, copies(500)[0]), (8, copies(500)[1]), (None, None)]
    docs = documents(spark, rows)
    kept = ngram_jaccard.keep_first(docs, ngram_jaccard.judge_documents(docs)).collect()
    assert Counter((r.doc_id, r.text and r.text.split()[0]) for r in kept) == Counter(
        [(None, "word100"), (5, "word300"), (8, "word500"), (None, None)])


def test_components_of_nothing(empty):
    assert ngram_jaccard.judge_documents(empty).count() == 0
