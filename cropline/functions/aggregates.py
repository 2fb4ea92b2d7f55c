"""Aggregates with an explicit rule for missing values, and the window forms built on them."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from cropline.functions.scalars import _col, ratio


def sum_or_null(c: Column | str) -> Column:
    """Null as soon as one value in the group is null."""
    return F.when(F.count(_col(c)) == F.count(F.lit(1)), F.sum(_col(c)))


def sum_or_zero(c: Column | str) -> Column:
    """Nulls skipped; 0 for a group without values."""
    return F.coalesce(F.sum(_col(c)), F.lit(0))


def sum_skip_null(c: Column | str) -> Column:
    """SQL SUM: nulls skipped; null for a group without values."""
    return F.sum(_col(c))


def _sum_or_null_over(c: Column | str, w: WindowSpec) -> Column:
    return F.when(F.count(_col(c)).over(w) == F.count(F.lit(1)).over(w), F.sum(_col(c)).over(w))


def share_within(c: Column | str, *by: str) -> Column:
    """Value divided by its group's total. Meant for frames that are already aggregated."""
    return ratio(_col(c), _sum_or_null_over(c, Window.partitionBy(*by)))


def running_sum(c: Column | str, by: str, order: str) -> Column:
    """Running total in ``order``; null from the first null value on."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _sum_or_null_over(c, w)
