"""Season bounds and the season-to-date filter."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropline.functions.scalars import date_in_year, ieee_div, is_known, plus_days
from cropline.sources.tables import land


def with_packout(batches: DataFrame) -> DataFrame:
    return batches.withColumn("packout", 1 - ieee_div("reject_kgs", "input_kgs"))


def season_bounds(
    batches: DataFrame,
    site: str | None = None,
    month_day: str | None = None,
    days: int | None = None,
    seasons: Iterable[int] | None = None,
) -> DataFrame:
    """season, first_harvest, first_pack, close.

    With ``site``, only that packing site's batches with a known packout count. The close date is
    ``month_day`` of the season's own year, or ``days`` after the first pack date.
    """
    if (month_day is None) == (days is None):
        raise ValueError("give exactly one of month_day and days")
    if site is not None:
        batches = with_packout(batches).filter((F.col("pack_site") == site) & is_known("packout"))
    if seasons is not None:
        batches = batches.filter(F.col("season").isin(list(seasons)))
    firsts = batches.groupBy("season").agg(
        F.min("harvest_date").alias("first_harvest"), F.min("pack_date").alias("first_pack")
    )
    close = date_in_year("season", month_day) if month_day is not None else plus_days("first_pack", days)
    return firsts.withColumn("close", close)


def _inside(date: Column, lower: Column | None, close: Column, upper: str) -> Column:
    below = date <= close if upper == "le" else date < close
    return below if lower is None else (date >= lower) & below


def one_per_season(bounds: DataFrame) -> DataFrame:
    """The widest bounds of each season, for sources that list a season more than once."""
    known = bounds.filter(F.col("season").isNotNull() & F.col("close").isNotNull())
    firsts = [F.min(c).alias(c) for c in ("first_harvest", "first_pack") if c in bounds.columns]
    return known.groupBy("season").agg(*firsts, F.max("close").alias("close"))


def land_bounds(bounds: DataFrame, folder: str) -> DataFrame:
    """One row per season, worked out once and kept in a shared folder, for reports of which several figures need it."""
    return land(one_per_season(bounds).coalesce(1), folder)


def season_to_date(
    df: DataFrame,
    bounds: DataFrame | None,
    date_col: str,
    lower: str | None = None,
    upper: str = "le",
    landed: bool = False,
) -> DataFrame:
    """Rows of each bounded season from ``lower`` (a bounds column) to the close date.

    ``upper`` is ``le`` or ``lt``. Seasons without bounds are dropped; ``bounds=None`` keeps everything.
    A season listed more than once has its earliest start and latest close. The bounds are joined on season with the
    range as a residual. Where ``df`` is ``landed`` by season and the bounds are landed too, so that Spark knows that they
    are few, their broadcast prunes its folders at run time and they are read once. Elsewhere the range over all seasons is a scalar subquery besides, which Spark
    works out first and pushes into the scan of ``df``.
    """
    if upper not in ("le", "lt"):
        raise ValueError(f"upper must be 'le' or 'lt', not {upper!r}")
    if bounds is None:
        return df
    limits = one_per_season(bounds).select(
        "season", F.col("close").alias("__close"), *([F.col(lower).alias("__lower")] if lower else [])
    )
    date = F.col(date_col)
    if landed:
        # Bounds that close before they start have no rows; a comparison is also what makes Spark expect fewer seasons.
        limits = limits.filter(F.col("__close") >= (F.col("__lower") if lower else F.lit("0001-01-01").cast("date")))
    else:
        known = bounds.filter(F.col("season").isNotNull() & F.col("close").isNotNull())
        overall = date <= known.agg(F.max("close")).scalar()
        if lower:
            overall = (date >= known.agg(F.min(lower)).scalar()) & overall
        df = df.filter(overall)
    inside = _inside(date, F.col("__lower") if lower else None, F.col("__close"), upper)
    return df.join(limits, "season").filter(inside).select(*[f"`{c}`" for c in df.columns])
