"""Budgeted chat windows.

A conversation's turns are formatted with the template ``<|im_start|>role\\ntext<|im_end|>\\n`` and cut into windows of
at most ``budget`` tokens along turns. Running token sums choose how many new turns a window takes; the system turn is
put in front of every window, followed by as many of the turns just before as fit into ``history`` tokens. A window's
loss spans cover the texts of its new assistant turns only, so that each is a target once: what is repeated is masked.
A turn that is longer than what a window has left for new turns gets a window of its own.

Texts and roles are escaped so that a template mark can't occur in them: a backslash becomes ``\\b``, ``<|`` becomes
``\\l`` and, in roles, a line feed becomes ``\\n``; replacing these back, the backslash last, restores them.

Tokens are estimated as code points / 4, rounded up, of the formatted turn (``token_count`` can be another expression).
Turns are grouped by conversation and by blocks of ``block_turns`` turn numbers, and no window crosses a block, so a
conversation of any number of turns is spread over tasks; only its system turn is sent to all its blocks.

Defined cases: null texts and roles are empty; a null conversation id is a conversation of its own; a null turn comes
first; repeated rows and equal turn numbers are kept, ordered by turn, role and text; a system turn that is not the
first turn is an ordinary turn; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("\\l"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\n"), F.lit("\n")) if role else text
    return F.replace(F.replace(out, F.lit("\\l"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def formatted(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role, role=True), F.lit("\n"), escape(text), F.lit(CLOSE))


def quarter(turn: Column) -> Column:
    return F.ceil(F.length(turn) / 4).cast("int")


def windows(
    turns: DataFrame, budget: int = 512, history: int = 128, block_turns: int = 256,
    conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    token_count: Callable[[Column], Column] = quarter,
) -> DataFrame:
    """(conv_id, block, window, text, n_repeated, n_tokens, loss): a row per window.

    ``n_repeated`` turns at its start are repeated; ``loss`` holds (start, end) of the targets in code points.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(1 << 62))))
    said = F.struct("turn", "role", "text")
    heads = rows.groupBy("conv_id").agg(F.min(F.struct("turn", "role", F.xxhash64("text").alias("h"))).alias("f"))
    # Few rows have the role; of these the one that is its conversation's first row is the system turn.
    system = rows.filter("role = 'system'").groupBy("conv_id").agg(F.min(said).alias("s"))
    system = system.join(heads.select(F.col("conv_id").alias("h_id"), "f"), F.col("conv_id").eqNullSafe(F.col("h_id"))).filter(
        (F.col("f.role") == "system") & F.col("f.turn").eqNullSafe(F.col("s.turn"))).select(
        F.col("conv_id").alias("s_id"), F.col("s.turn").alias("s_turn"), F.col("s.text").alias("s_text"),
        F.coalesce(F.floor(F.col("s.turn") / block_turns), F.lit(-(1 << 62))).alias("s_block"))
    blocks = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(said)).alias("turns")).join(
        system, F.col("conv_id").eqNullSafe(F.col("s_id")), "left")
    marked = F.transform("turns", lambda x: F.struct(
        formatted(x["role"], x["text"]).alias("t"), (x["role"] == "assistant").alias("target"),
        (F.length(F.lit(OPEN)) + F.length(escape(x["role"], role=True)) + 1).alias("from"), F.length(escape(x["text"])).alias("size")))
    blocks = blocks.select(
        "conv_id", "block", marked.alias("turns"), (F.col("block") == F.col("s_block")).alias("has_system"),
        F.when(F.col("s_id").isNotNull() | F.col("s_text").isNotNull(), formatted(F.lit("system"), F.col("s_text"))).alias("system"))
    blocks = blocks.withColumns({
        "cost": F.transform("turns", lambda x: token_count(x["t"])),
        "system_cost": F.coalesce(token_count(F.col("system")), F.lit(0)),
        "own": F.coalesce(F.col("has_system"), F.lit(False))})
    blocks = blocks.withColumns({
        "total": F.aggregate("cost", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))),
        "room": F.greatest(F.lit(1), F.lit(budget - history) - F.col("system_cost"))})
    # Starts of windows: a turn starts one when the running sum since the last start would pass the room.
    starts = F.aggregate(
        F.sequence(F.lit(1), F.size("turns")), F.struct(F.array(F.lit(1)).alias("at"), F.lit(0).cast("long").alias("base")),
        lambda a, i: F.when((F.get("total", i) - a["base"] > F.col("room")) & (i > F.element_at(a["at"], -1)), F.struct(
            F.concat(a["at"], F.array(i)).alias("at"), F.get("total", i - 1).alias("base"))).otherwise(a), lambda a: a["at"])
    each = blocks.withColumn("starts", starts).select("*", F.posexplode("starts").alias("window", "first"))
    last = F.coalesce(F.get("starts", F.col("window") + 1) - 1, F.size("turns"))
    # The system turn, if it is in this block, is never history: it is in front already.
    lowest = F.when(F.col("own"), 2).otherwise(1)
    back = F.size(F.filter(F.sequence(F.lit(1), F.col("first")), lambda i: (i >= lowest) & (i < F.col("first")) & (
        F.get("total", F.col("first") - 1) - F.get("total", i - 1) <= history)))
    each = each.select("conv_id", "block", "window", "first", last.alias("last"), back.alias("back"), "turns", "system", "own", "total", "system_cost")
    repeats_system = F.col("system").isNotNull() & ~(F.col("own") & (F.col("first") == 1))
    before = F.when(repeats_system, F.col("system")).otherwise("")
    old = F.slice("turns", F.col("first") - F.col("back"), F.col("back"))
    new = F.slice("turns", F.col("first"), F.col("last") - F.col("first") + 1)
    lead = F.concat(before, F.array_join(F.transform(old, lambda x: x["t"]), ""))
    each = each.select(
        "conv_id", "block", "window", lead.alias("lead"), new.alias("new"), (F.col("back") + repeats_system.cast("int")).alias("n_repeated"),
        (F.when(repeats_system, F.col("system_cost")).otherwise(0) + F.get("total", F.col("last"))
         - F.get("total", F.col("first") - F.col("back") - 1)).alias("n_tokens"))
    loss = F.aggregate("new", F.struct(F.length("lead").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
                       lambda a, x: F.struct(
        (a["at"] + F.length(x["t"])).alias("at"), F.when(x["target"], F.concat(a["spans"], F.array(F.struct(
            (a["at"] + x["from"]).alias("start"), (a["at"] + x["from"] + x["size"]).alias("end"))))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"])
    return each.select("conv_id", "block", "window", F.concat("lead", F.array_join(F.transform("new", lambda x: x["t"]), "")).alias("text"),
                       "n_repeated", "n_tokens", loss.alias("loss"))


def read_back(made: DataFrame) -> DataFrame:
    """Turns and targets of each conversation, read from the windows' texts, masks and counts of repeated turns."""
    parts = F.split("text", r"<\|im_end\|>\n", -1)
    turns = F.slice(parts, F.col("n_repeated") + 1, F.size(parts) - 1 - F.col("n_repeated"))
    parsed = F.transform(turns, lambda x: F.concat(
        unescape(F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), "\n", 1), role=True), F.lit("\n"),
        unescape(F.substr(x, F.lit(len(OPEN) + 2) + F.length(F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), "\n", 1)))), F.lit("\n")))
    targets = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    said = made.select("conv_id", "block", "window", F.size(turns).alias("n"), F.array_join(parsed, "").alias("turns"),
                       F.array_join(targets, "").alias("loss"), F.length("text").alias("chars"))
    ordered = said.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("block", "window", "turns", "loss"))).alias("w"))
    joined = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    return ordered.select(
        "conv_id", "n_turns", F.sha2(joined("turns"), 256).alias("turns_sha256"), F.length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"), "formatted_chars")
