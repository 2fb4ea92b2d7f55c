"""Small reshaping helpers shared by datasets and operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropline.functions.aggregates import sum_or_null
from cropline.operators.ordered import row_index


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Project and rename: ``pick(df, season_id="SeasonID")``."""
    return df.selectExpr(*[f"`{source}` AS `{name}`" for name, source in columns.items()])


def relocate_first(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, *[c for c in df.columns if c not in columns])


def sum_across(columns: Iterable[Column]) -> Column:
    """Row-wise sum of several columns; null if one of them is null."""
    return reduce(add, columns)


def column_names(df: DataFrame, names_from: str, most: int = 10_000) -> list:
    """The distinct values that become pivot columns, sorted, null last. They are column names, so they go to the driver.

    More than ``most`` of them are an error, not a table.
    """
    names = [r[0] for r in df.select(names_from).distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"{names_from} has more than {most} values, which cannot all be columns")
    return sorted(n for n in names if n is not None) + [None] * (None in names)


def pivot_wider(
    df: DataFrame, by: Sequence[str], names_from: str, values_from: str, names: Sequence, fill=0
) -> DataFrame:
    """One column per listed name; None makes the column ``null``. ``df`` has at most one row per (by, name).

    Cells without a row get ``fill``; a cell whose value is null stays null.
    """
    cells = []
    for name in names:
        here = F.col(names_from).eqNullSafe(F.lit(name))
        cells.append(
            F.when(F.count_if(here) > 0, F.max(F.when(here, F.col(values_from)))).otherwise(F.lit(fill)).alias("null" if name is None else str(name))
        )
    return df.groupBy(*by).agg(*cells)


def with_total_row(df: DataFrame, key: str, columns: Sequence[str], label: str = "Total") -> DataFrame:
    """Append one row with the column sums. ``df`` is a report table with one row per key."""
    is_total = F.grouping(key).alias("__total")
    return (
        df.rollup(key)
        .agg(is_total, *[sum_or_null(f"`{c}`").alias(c) for c in columns])
        .withColumn(key, F.when(F.col("__total") == 1, F.lit(label)).otherwise(F.col(key)))
        .drop("__total")
    )


def union_sources(sources: Mapping[str, DataFrame], label: str = "source_db") -> DataFrame:
    """Append frames of the same shape by column name; columns missing in one are null there."""
    tagged = [df.withColumn(label, F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the keys appear once, from the left side."""
    marked = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(marked, condition, how).drop(*[f"__{k}" for k in keys])


def join_null_spread(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", rows_per_task: int = 1_000_000
) -> DataFrame:
    """``join_null_safe`` for frames of which many rows lack a key.

    All rows without a key are one group, which no hash can part. Those of ``left`` are dealt by their other columns over
    a task for each ``rows_per_task`` of them, and those of ``right``, the smaller side, are repeated for each of these. How
    many that are is a scalar subquery, so nothing runs while the plan is built. Rows with all keys join as ever.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how!r} would repeat rows that only the right side has")
    some_null = reduce(or_, [F.col(f"`{k}`").isNull() for k in keys])
    shares = F.greatest(F.lit(1).cast("bigint"), left.agg(F.ceil(F.count_if(some_null) / rows_per_task)).scalar())
    columns = [F.col(f"`{c}`") for c in left.columns]
    dealt = left.withColumn("__share", F.when(some_null, F.pmod(F.xxhash64(*columns), shares)).otherwise(0))
    copies = F.when(some_null, F.sequence(F.lit(0).cast("bigint"), shares - 1)).otherwise(F.array(F.lit(0).cast("bigint")))
    marked = right.withColumn("__copy", F.explode(copies)).withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"`__{k}`")) for k in keys], F.col("__share") == F.col("__copy"))
    return dealt.join(marked, condition, how).drop("__share", "__copy", *[f"__{k}" for k in keys])


def left_join_spread(left: DataFrame, right: DataFrame, key: str, spread_by: Sequence[str]) -> DataFrame:
    """Left join on ``key`` in which rows without a key, which match nothing, are dealt out by other columns.

    ``right`` has at most one row per key. Without this all rows whose key is null meet in one task.
    """
    marked = left.withColumns({"__key": F.coalesce(F.col(key).cast("bigint"), F.xxhash64(*spread_by)), "__known": F.col(key).isNotNull()})
    other = right.filter(F.col(key).isNotNull()).withColumns({"__key": F.col(key).cast("bigint"), "__known": F.lit(True)}).drop(key)
    return marked.join(other, ["__key", "__known"], "left").drop("__key", "__known")


def keep_members(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``members``."""
    return df.join(members.select(key).distinct(), key, "left_semi")


def bind_columns(
    left: DataFrame, right: DataFrame, left_order: str | Sequence[str], right_order: str | Sequence[str], folder: str
) -> DataFrame:
    """Put two frames side by side by row position in their orders; positions that only one has are dropped.

    Positions come from ``ordered.row_index``, which lands both frames below ``folder``. Rows of equal order are placed by
    their other columns.
    """
    def placed(df: DataFrame, order: str | Sequence[str], side: str) -> DataFrame:
        first = [order] if isinstance(order, str) else list(order)
        rest = [c for c in df.columns if c not in first]
        return row_index(df, [F.col(f"`{c}`") for c in first + rest], "__row", f"{folder.rstrip('/')}/{side}")

    return placed(left, left_order, "left").join(placed(right, right_order, "right"), "__row").drop("__row")
