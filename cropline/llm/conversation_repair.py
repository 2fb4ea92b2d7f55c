"""Conversation structure repair: weighted CYK interval parsing of turns under a repair grammar.

A conversation is right if its role initials are ``(s?(ua)+)?``. A repair keeps (K, cost 0), reroles (R, 3) or deletes (D, 4)
each row and inserts (I, 3) empty user or assistant turns anywhere; a row that is cut short adds 3 unless deleted; blank rows
and rows that repeat an earlier (role, text) must be deleted. Of the cheapest repairs that with the ASCII-least audit, the
initials of its edits in order, is taken.

* **Grammar.** States of the right conversations are 0 (nothing yet), 1 (a system turn), 2 (a user turn), 3 (an assistant
  turn); 0 and 3 may end. A nonterminal ``pq`` stands for all edits that lead from state p to state q. It is in Chomsky
  normal form: ``pq -> pr rq`` for every state r between, and ``pq -> a row's edit``. ``NONTERMINALS`` has the eleven that
  can be, ``RULES`` the 26 binary rules.
* **Cells.** The cell of a span of rows holds the minimum (cost, audit) of each nonterminal. Insertion closure: a leaf is
  (insertions) (one edit) (insertions), where the closure of insertions takes the fewest turns between two states.
* **Combination.** Cells are combined bottom-up by span length: leaves, pairs, pairs of pairs. One split of a span is
  enough: a derivation of ``pq`` passes some state at every row border, so every split gives the same minimum. (At equal
  cost no audit is a prefix of another one, as it would cost its surplus insertions less; so the least audits of the parts
  give the least audit of the whole.)
* **Spark.** Equal rows of a turn are counted before anything else. Rows are dealt by ranges of (conversation, turn, role,
  text), so a conversation of any length lies over many tasks in order; tasks write spans of at most ``SPAN_ROWS`` rows
  with their cells. Spans of one conversation are merged ``FAN_IN`` at a time in rounds, and the chosen states go back down
  the same rounds to the rows. No group of any of these steps has more than ``FAN_IN`` spans.

Defined cases: a null role or text is one space; a null turn comes before all others; a null conversation id is a
conversation of its own. Rows of equal turn are ordered by role, then by the first ``HEAD`` code points of the text, then by
the text's hash; equal rows are next to each other, and all but the first of them are duplicates. A role whose initial is
not s, u or a can only be reroled or deleted. Very long texts end a span early and are never cut. An empty table gives no
rows. Other columns are not looked at, so their names never clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cropline.llm.common import stored

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: Rows and characters of a span at most (one row at least), and spans that are merged at once.
SPAN_ROWS, SPAN_CHARS, FAN_IN = 256, 1 << 20, 16
#: Code points of a text that order rows of equal turn and role.
HEAD = 32
BLANK = r"[^\x20\x09-\x0D]"

STEPS = {(0, 1): "s", (0, 2): "u", (1, 2): "u", (2, 3): "a", (3, 2): "u"}
NONTERMINALS = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
NUMBER = {pair: i for i, pair in enumerate(NONTERMINALS)}
RULES = [(NUMBER[p, q], NUMBER[p, r], NUMBER[r, q]) for p, q in NONTERMINALS for r in range(4)
         if (p, r) in NUMBER and (r, q) in NUMBER]

#: A cell: per nonterminal None or the minimum (cost, audit).
Cell = list


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: Cell = [None] * len(NONTERMINALS)
    for a, b, c in RULES:
        x, y = left[b], right[c]
        if x is None or y is None:
            continue
        best, cost = out[a], x[0] + y[0]
        if best is None or cost < best[0] or cost == best[0] and x[1] + y[1] < best[1]:
            out[a] = (cost, x[1] + y[1])
    return out


def _closure() -> Cell:
    """Any number of insertions: empty at no cost, and single insertions put together until nothing changes."""
    empty = [(0, "") if p == q else None for p, q in NONTERMINALS]
    once = [(INSERT, "I") if STEPS.get(pair, "s") != "s" else None for pair in NONTERMINALS]
    smaller = lambda x, y: x if y is None else y if x is None else min(x, y)
    cell = empty
    while True:
        wider = [smaller(x, y) for x, y in zip(cell, combined(cell, once))]
        if wider == cell:
            return cell
        cell = wider


INSERTIONS = _closure()


def edited(initial: str, truncated: bool, bad: bool) -> Cell:
    """The leaf of one row: insertions, one edit, insertions."""
    cell: Cell = [(DELETE, "D") if p == q else None for p, q in NONTERMINALS]
    for pair, role in STEPS.items():
        if not bad:
            extra = CUT if truncated else 0
            ways = [(KEEP + extra, "K")] * (role == initial) + [(REROLE + extra, "R")] * (role != "s")
            if ways:
                cell[NUMBER[pair]] = min(ways)
    return combined(combined(INSERTIONS, cell), INSERTIONS)


LEAVES = {(i, t): edited(i, t, False) for i in ("s", "u", "a", "") for t in (False, True)}


def deleted(n: int) -> Cell:
    """The cell of ``n`` rows that must go: deletions sort before insertions."""
    return [None if x is None else (DELETE * n + x[0], "D" * n + x[1]) for x in INSERTIONS]


def row_cells(row: dict) -> list[Cell]:
    """Leaves of a row that stands there ``n`` times."""
    n = row["n"]
    if row["fault"] in ("blank", "duplicate"):
        return [deleted(n)]
    initial = row["role"][:1]
    first = LEAVES[initial if initial in ("s", "u", "a") else "", row["fault"] == "truncated"]
    return [first, deleted(n - 1)] if n > 1 else [first]


def parsed(cells: list[Cell]) -> Cell:
    """The cell of a whole sequence, combined bottom-up by span length."""
    if not cells:
        return [(0, "") if p == q else None for p, q in NONTERMINALS]
    while len(cells) > 1:
        cells = [combined(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def best_end(cell: Cell) -> tuple[int, int, str]:
    """(end state, cost, audit) of a whole conversation."""
    ends = [(*cell[NUMBER[0, q]], q) for q in (0, 3) if cell[NUMBER[0, q]] is not None]
    cost, audit, q = min(ends)
    return q, cost, audit


def states_between(cells: list[Cell], p: int, q: int) -> list[tuple[int, int]]:
    """The (start, end) states of neighbouring spans on the least way from p to q."""
    ways = {p: (0, "", [])}
    for cell in cells:
        nexts: dict = {}
        for r, (cost, audit, path) in ways.items():
            for s in range(4):
                x = cell[NUMBER[r, s]] if (r, s) in NUMBER else None
                if x is not None:
                    way = (cost + x[0], audit + x[1], [*path, (r, s)])
                    if s not in nexts or way[:2] < nexts[s][:2]:
                        nexts[s] = way
        ways = nexts
    return ways[q][2]


def replayed(rows: list[dict], state: int, audit: str) -> list[dict]:
    """What the edits of a span make of its rows, deleted ones included."""
    source = (r for row in rows for r in [row] * row["n"])
    out = []
    for edit in audit:
        row = next(source) if edit != "I" else None
        if edit == "D":
            out.append({"edit": edit, "role": row["role"], "text": row["text"]})
            continue
        initial = row["role"][:1] if edit == "K" else "a" if state == 2 else "u"
        state = {"s": 1, "u": 2, "a": 3}[initial]
        role = row["role"] if edit == "K" else "assistant" if initial == "a" else "user"
        out.append({"edit": edit, "role": role, "text": row["text"] if row else ""})
    return out


# --- counts of a span that its neighbours can be added to ------------------------------------------------------------

COUNTS = "n_rows long, n_turns long, low long, high long, head string, tail string, blank long, duplicate long, truncated long, illegal long"
ADDED = ("n_rows", "n_turns", "blank", "duplicate", "truncated", "illegal")


def joined(left: dict, right: dict) -> dict:
    """Counts of two neighbouring spans; either may be without rows."""
    if not left["n_rows"] or not right["n_rows"]:
        return left if left["n_rows"] else right
    out = {k: left[k] + right[k] for k in ADDED}
    out["n_turns"] -= left["high"] is not None and left["high"] == right["low"]
    out["illegal"] += left["tail"] + right["head"] not in ("su", "ua", "au")
    out["low"] = right["low"] if left["low"] is None else left["low"]
    out["high"] = left["high"] if right["high"] is None else right["high"]
    return out | {"head": left["head"], "tail": right["tail"]}


def row_counts(row: dict) -> dict:
    n, initial, fault = row["n"], row["role"][:1], row["fault"]
    return {
        "n_rows": n, "n_turns": int(row["turn"] is not None and n > 0), "low": row["turn"], "high": row["turn"], "head": initial,
        "tail": initial, "blank": n if fault == "blank" else 0, "truncated": int(fault == "truncated"),
        "duplicate": 0 if fault == "blank" else n if fault == "duplicate" else n - 1, "illegal": n - 1}


NO_ROWS = {"n_rows": 0, "n_turns": 0, "low": None, "high": None, "head": "", "tail": "", "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

CELL = "costs array<long>, audits array<string>"
ROWS = "array<struct<turn: long, role: string, text: string, n: long, fault: string>>"
SPAN = f"part long, span long, {COUNTS}, {CELL}"


def packed(cell: Cell) -> dict:
    return {"costs": [None if x is None else x[0] for x in cell], "audits": [None if x is None else x[1] for x in cell]}


def unpacked(row: dict) -> Cell:
    return [None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"])]


def span_writer(schema: pa.Schema, key_names: list[str]):
    """Sorted rows of a partition to spans; a span ends with its conversation, or when it is full."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        rows: list[dict] = []
        key, chars = None, 0

        def span() -> dict:
            there = [r for r in rows if r["n"]]
            cells = parsed([c for r in there for c in row_cells(r)])
            counts = reduce(joined, map(row_counts, there), NO_ROWS)
            return {"conv_id": key, "part": part, "span": number, **counts, **packed(cells), "rows": there}

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if rows and (row["conv_id"] != key or len(rows) >= SPAN_ROWS or chars + len(row["text"]) > SPAN_CHARS):
                    out.append(span())
                    rows, chars, number = [], 0, number + 1
                key = row["conv_id"]
                rows.append({k: row[k] for k in key_names})
                chars += len(row["text"])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if rows:
            yield pa.RecordBatch.from_pylist([span()], schema=schema)

    return run


def merge_spans(spans: list[dict]) -> tuple[dict, Cell]:
    return reduce(joined, spans, NO_ROWS), parsed([unpacked(s) for s in spans])


def span_merger(schema: pa.Schema):
    """A group of neighbouring spans of a conversation to one span that keeps their cells in order."""
    def run(table: pa.Table) -> pa.Table:
        spans = sorted(table.to_pylist(), key=lambda s: (s["part"], s["span"]))
        counts, cell = merge_spans(spans)
        first = spans[0]
        children = [{k: s[k] for k in ("part", "span", "costs", "audits")} for s in spans]
        return pa.Table.from_pylist([{"conv_id": first["conv_id"], "part": first["up_part"], "span": first["up_span"],
                                      **{k: counts[k] for k in NO_ROWS}, **packed(cell), "children": children}], schema=schema)

    return run


def way_down(schema: pa.Schema):
    """From a merged span with its start and end state to those of its children."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ways = states_between([unpacked(c) for c in row["children"]], row["p"], row["q"])
                out += [{"conv_id": row["conv_id"], "part": c["part"], "span": c["span"], "p": p, "q": q}
                        for c, (p, q) in zip(row["children"], ways)]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def ender(schema: pa.Schema):
    """Whole conversations to their end state, cost and audit."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                q, cost, audit = best_end(unpacked(row))
                gaps = 0 if row["low"] is None else row["high"] - row["low"] + 1 - row["n_turns"]
                out.append({**{k: row[k] for k in ("conv_id", "part", "span", "blank", "duplicate", "truncated", "illegal")},
                            "gaps": gaps, "cost": cost, "audit": audit, "p": 0, "q": q})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def span_editor(schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                audit = unpacked(row)[NUMBER[row["p"], row["q"]]][1]
                out.append({"conv_id": row["conv_id"], "part": row["part"], "span": row["span"],
                            "edits": replayed(row["rows"], row["p"], audit)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


# --- Spark side --------------------------------------------------------------------------------------------------------

def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def counted_rows(turns: DataFrame, conv_id: str, turn: str, role: str, text: str, copies: Column) -> DataFrame:
    """Distinct rows of each turn with their number and first fault; rows of no copies only keep their conversation."""
    there = copies > 0
    known = lambda c: F.when(there, F.coalesce(F.col(c).cast("string"), F.lit(" "))).otherwise("")
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.when(there, F.col(turn).cast("long")).alias("turn"),
        known(role).alias("role"), known(text).alias("text"), copies.cast("long").alias("n"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    rows = rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    # The turn in which a (role, text) of a conversation is seen first. The join meets it by turn too, so no key is hot.
    firsts = rows.filter("n > 0").groupBy("conv_id", "role", "k1", "k2").agg(
        F.min(F.struct(F.col("turn").isNotNull(), F.col("turn"))).alias("first")).select(
        *[F.col(c).alias(f"f_{c}") for c in ("conv_id", "role", "k1", "k2")], F.col("first.turn").alias("f_turn"), F.lit(True).alias("is_first"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in ("conv_id", "turn", "role", "k1", "k2")])
    found = rows.join(firsts, same, "left")
    fault = F.when(F.col("n") == 0, "").when(~F.col("text").rlike(BLANK), "blank").when(F.col("is_first").isNull(), "duplicate").when(
        ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("")
    return found.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"), F.substring("text", 1, HEAD).alias("head"), "k1")


def parse(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
          copies: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(spans, verdicts). ``copies`` says how often a row stands there (1); 0 drops it, but not its conversation.

    spans: conv_id, part, span and ``edits`` (edit, role, text) in order of (part, span). verdicts, one row per conversation:
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    """
    rows = counted_rows(turns, conv_id, turn, role, text, F.lit(1) if copies is None else copies)
    order = ["conv_id", "turn", "role", "head", "k1"]
    id_column = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"
    ddl = f"{id_column}, {SPAN}, rows {ROWS}"
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    leaves = stored(dealt.mapInArrow(span_writer(arrow_schema(ddl), ["turn", "role", "text", "n", "fault"]), ddl), "repair-spans")

    several = leaves.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("of"))
    parts = leaves.drop("rows").join(several, F.col("conv_id").eqNullSafe(F.col("of")), "left_semi")
    whole = leaves.drop("rows").join(several, F.col("conv_id").eqNullSafe(F.col("of")), "left_anti")

    # Rounds: spans of a part are merged first, then parts.
    level, levels = stored(parts, "repair-parts"), []
    merged_ddl = f"{id_column}, {SPAN}, children array<struct<part: long, span: long, costs: array<long>, audits: array<string>>>"
    merger = span_merger(arrow_schema(merged_ddl))
    most = level.agg(F.max("span").alias("span"), F.max("part").alias("part")).first()
    while most.part is not None and (most.span or most.part):
        up = (F.lit(0) if not most.span else F.floor(F.col("span") / FAN_IN)).cast("long")
        up_part = (F.col("part") if most.span else F.floor(F.col("part") / FAN_IN)).cast("long")
        keyed = level.drop("children").withColumns({"up_part": up_part, "up_span": up})
        merged = stored(keyed.groupBy("conv_id", "up_part", "up_span").applyInArrow(merger, merged_ddl), "repair-merged")
        levels.append(merged)
        level = merged
        most = level.agg(F.max("span").alias("span"), F.max("part").alias("part")).first()

    states = f"{id_column}, part long, span long, p int, q int"
    ends_ddl = f"{states}, blank long, duplicate long, truncated long, illegal long, gaps long, cost long, audit string"
    ends = stored(whole.unionByName(level.drop("children")).mapInArrow(ender(arrow_schema(ends_ddl)), ends_ddl), "repair-ends")

    keys = ["conv_id", "part", "span"]

    def placed(df: DataFrame, chosen: DataFrame) -> DataFrame:
        """``df`` with the states of its spans; (part, span) names a span at its level, and tells equal parts apart with conv_id."""
        c = chosen.select(*[F.col(k).alias(f"c_{k}") for k in keys], "p", "q")
        return df.join(c, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in keys])).drop(*[f"c_{k}" for k in keys])

    down = way_down(arrow_schema(states))
    top = ends.select("conv_id", "part", "span", "p", "q")
    chosen = top.join(several, F.col("conv_id").eqNullSafe(F.col("of")), "left_semi")
    for merged in reversed(levels):
        chosen = stored(placed(merged.select(*keys, "children"), chosen).mapInArrow(down, states), "repair-states")
    chosen = top.join(several, F.col("conv_id").eqNullSafe(F.col("of")), "left_anti").unionByName(chosen)
    edits_ddl = f"{id_column}, part long, span long, edits array<struct<edit: string, role: string, text: string>>"
    spans = placed(leaves.select(*keys, "costs", "audits", "rows"), chosen).mapInArrow(span_editor(arrow_schema(edits_ddl)), edits_ddl)
    verdicts = ends.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return spans, verdicts


def repaired_turns(spans: DataFrame) -> DataFrame:
    """The repaired conversations as rows: conv_id, part, span, place (order by these), edit, role, text; deleted rows are left out."""
    rows = spans.select("conv_id", "part", "span", F.posexplode("edits").alias("place", "e"))
    return rows.filter("e.edit <> 'D'").select("conv_id", "part", "span", "place", "e.edit", "e.role", "e.text")


def digest(spans: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``verdicts`` and the hash of each repaired conversation (``role:text``, newline-joined), whose text must fit in one row."""
    lines = F.transform(F.filter("edits", lambda e: e["edit"] != "D"), lambda e: F.concat(e["role"], F.lit(":"), e["text"]))
    texts = spans.select("conv_id", "part", "span", F.array_join(lines, "\n").alias("body"), (F.size(lines) > 0).alias("any")).filter("any")
    whole = texts.groupBy(F.col("conv_id").alias("of")).agg(
        F.array_sort(F.collect_list(F.struct("part", "span", "body"))).alias("bodies"))
    found = verdicts.join(whole, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    body = F.coalesce(F.array_join(F.transform("bodies", lambda b: b["body"]), "\n"), F.lit(""))
    return found.select(*verdicts.columns, F.sha2(body, 256).alias("repaired_sha256"))


def damage(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with faults by crc32(``conv_id:turn``) % 20, and how often each row stands there afterwards."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).alias("fault")
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault)
    hurt = rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("copies"))
    return hurt, F.col("copies")
