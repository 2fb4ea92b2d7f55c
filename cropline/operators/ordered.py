"""Row numbers and running totals over any number of rows: rows are dealt by ranges of their order and each range counted apart.

Both land the ordered rows in a folder that the caller names and that all executors share, so that a range's number and a
row's place in it are the same for every later step, also after an executor is lost.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropline.sources.tables import land

#: monotonically_increasing_id keeps the number of the task above these bits and the row's number in it below.
ROW_BITS = 33


def in_ranges(df: DataFrame, order: Sequence[Column | str], folder: str) -> DataFrame:
    """``df`` in ``order`` with ``__range`` and ``__at``: a range's rows come before the next range's, and are numbered from 0."""
    # The numbering must read the sorted rows of its own task, so it follows the sort in the same stage.
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    rows = land(dealt, folder)
    return rows.withColumns({
        "__range": F.shiftrightunsigned("__id", ROW_BITS), "__at": F.col("__id").bitwiseAND((1 << ROW_BITS) - 1)}).drop("__id")


def range_starts(rows: DataFrame) -> DataFrame:
    """(__range, __start): rows before each range. One row per range, in one array, whose parts are summed."""
    sizes = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).agg(
        F.array_sort(F.collect_list(F.struct("__range", "n"))).alias("sizes"))
    before = lambda i: F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0).cast("bigint"), lambda total, s: total + s["n"])
    starts = F.transform("sizes", lambda s, i: F.struct(s["__range"].alias("__range"), before(i).alias("__start")))
    return sizes.select(F.explode(starts).alias("s")).select("s.*")


def row_index(df: DataFrame, order: Sequence[Column | str], name: str, folder: str) -> DataFrame:
    """``df`` with the place of each row in ``order``, from 1, as ``name``.

    Rows of equal order have different places next to each other. Only the rows of one range meet in a task, and only the
    sizes of the ranges meet in one row.
    """
    rows = in_ranges(df, order, folder)
    place = (F.col("__start") + F.col("__at") + 1).alias(name)
    return rows.join(range_starts(rows), "__range").select(*[F.col(f"`{c}`") for c in df.columns], place)


def running_total(
    df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], name: str, folder: str
) -> DataFrame:
    """``df`` with the running sum of ``value`` within ``by``, in ``order``, as ``name``; null from the first null on.

    Two levels: running sums inside each range of a group, and before them the sums of the group's earlier ranges. A group
    of any size lies over many ranges; the window over its ranges sees one row for each.
    """
    rows = in_ranges(df, [*by, *order], folder)
    missing = F.col(value).isNull().cast("bigint")
    totals = rows.groupBy(*by, "__range").agg(F.sum(value).alias("__sum"), F.sum(missing).alias("__gone"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(f"`{c}`").alias(f"__by{i}") for i, c in enumerate(by)], F.col("__range").alias("__of"),
        F.sum("__sum").over(earlier).alias("__before"), F.sum("__gone").over(earlier).alias("__before_gone"))
    inside = Window.partitionBy("__range", *by).orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({"__local": F.sum(value).over(inside), "__local_gone": F.sum(missing).over(inside)})
    same = reduce(and_, [F.col(f"`{c}`").eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)], F.col("__range") == F.col("__of"))
    gone = F.col("__local_gone") + F.coalesce("__before_gone", F.lit(0))
    total = F.col("__local") + F.coalesce("__before", F.lit(0))
    return local.join(carried, same).select(
        *[F.col(f"`{c}`") for c in df.columns], F.when(gone == 0, total).alias(name))
