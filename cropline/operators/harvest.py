"""Harvest progress, rate, pick yield and tipping tables.

Inputs are the delivery and tipping datasets; ``bounds`` comes from ``bounds.season_bounds``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropline.functions.aggregates import running_sum, share_within, sum_or_null
from cropline.functions.scalars import date_in_year, days_between, move_to_year, ratio
from cropline.operators.bounds import one_per_season, season_to_date
from cropline.operators.relational import column_names, pivot_wider, with_total_row

Bounds = DataFrame


def not_presized(deliveries: DataFrame) -> DataFrame:
    return deliveries.filter(~F.col("presize_flag"))


def harvest_by_site(deliveries: DataFrame, bounds: Bounds, sites: Sequence[str] | None = None) -> DataFrame:
    """Bins harvested to date: one row per season, one column per storage site, and the total of all of them.

    With ``sites`` listed, the other sites share the column ``other_sites``, and deliveries without a site have
    ``no_site``; no job is needed to find the sites.
    """
    to_date = season_to_date(not_presized(deliveries), bounds, "harvest_date", lower="first_harvest")
    site = F.col("storage_site")
    if sites is None:
        sites = [s for s in column_names(to_date, "storage_site") if s is not None]
    columns = {s: site.eqNullSafe(F.lit(s)) for s in sites}
    columns["other_sites"] = site.isNotNull() & ~site.isin(list(sites)) if sites else site.isNotNull()
    columns["no_site"] = site.isNull()
    bins = F.col("no_of_bins")
    known = lambda here: F.count_if(here & bins.isNull()) == 0
    cells = [F.when(known(here), F.coalesce(F.sum(F.when(here, bins)), F.lit(0))).alias(name) for name, here in columns.items()]
    return to_date.groupBy("season").agg(*cells, sum_or_null("no_of_bins").alias("total"))


def harvest_total(deliveries: DataFrame, bounds: Bounds) -> DataFrame:
    """season, bins: harvested to date over all sites."""
    return (
        season_to_date(not_presized(deliveries), bounds, "harvest_date", lower="first_harvest")
        .groupBy("season")
        .agg(sum_or_null("no_of_bins").alias("bins"))
    )


def harvest_duration(deliveries: DataFrame) -> DataFrame:
    """First and last harvest day of each season and the days between them."""
    return (
        not_presized(deliveries)
        .groupBy("season")
        .agg(F.min("harvest_date").alias("first_harvest"), F.max("harvest_date").alias("last_harvest"))
        .withColumn("harvest_days", days_between("first_harvest", "last_harvest"))
    )


def harvest_rate(deliveries: DataFrame, seasons: Sequence[int] | None = None) -> DataFrame:
    """Bins per harvest day. One pass gives both the bins and the duration."""
    if seasons is not None:
        deliveries = deliveries.filter(F.col("season").isin(list(seasons)))
    return (
        not_presized(deliveries)
        .groupBy("season")
        .agg(
            sum_or_null("no_of_bins").alias("bins"),
            days_between(F.min("harvest_date"), F.max("harvest_date")).alias("harvest_days"),
        )
        .withColumn("bins_per_day", ratio("bins", "harvest_days"))
    )


def pick_share(deliveries: DataFrame) -> DataFrame:
    """Each pick's share of its season's bins. Presized deliveries count here."""
    return (
        deliveries.groupBy("season", "pick_no")
        .agg(sum_or_null("no_of_bins").alias("bins"))
        .withColumn("share", share_within("bins", "season"))
    )


def cumulative_harvest(deliveries: DataFrame, bounds: Bounds, month_day: str, plot_year: int = 2024) -> DataFrame:
    """Daily and running bins per season, with every date moved onto one plot year and cut at the close day."""
    daily = (
        season_to_date(not_presized(deliveries), bounds, "harvest_date", lower="first_harvest")
        .groupBy("season", "harvest_date")
        .agg(sum_or_null("no_of_bins").alias("bins"))
    )
    return running_harvest(daily, month_day, plot_year)


def running_harvest(daily: DataFrame, month_day: str, plot_year: int = 2024) -> DataFrame:
    """Running total over daily rows (season, harvest_date, bins); at most 366 rows per season."""
    return (
        daily.withColumn("cum_bins", running_sum("bins", "season", "harvest_date"))
        .withColumn("plot_date", move_to_year("harvest_date", plot_year))
        .filter(F.col("plot_date") <= date_in_year(F.lit(plot_year), month_day))
    )


def _of(season: int, value: Column) -> Column:
    return F.max(F.when(F.col("season") == season, value))


def harvest_growth(bins: DataFrame, bounds: Bounds, current: int, prior: int) -> DataFrame:
    """Growth in bins per day and in bins from ``prior`` to ``current``.

    ``growth_as_published`` divides by the prior bins over the *current* season's days, as the
    published figure does; ``growth_consistent`` uses the prior season's own days.
    """
    seasons = bins.join(one_per_season(bounds), "season").withColumn("days", days_between("first_harvest", "close"))
    b, d = F.col("bins").cast("double"), F.col("days").cast("double")
    pair = seasons.filter(F.col("season").isin(current, prior)).agg(
        _of(current, b).alias("b1"), _of(prior, b).alias("b0"), _of(current, d).alias("d1"), _of(prior, d).alias("d0")
    )
    rate1, rate0 = ratio("b1", "d1"), ratio("b0", "d0")
    return pair.select(
        ratio(rate1 - rate0, ratio("b0", "d1")).alias("growth_as_published"),
        ratio(rate1 - rate0, rate0).alias("growth_consistent"),
        ratio(F.col("b1") - F.col("b0"), "b0").alias("total_growth"),
    )


def _tipped_to_date(tipped: DataFrame, bounds: Bounds, *by: str) -> DataFrame:
    return (
        season_to_date(tipped, bounds, "pack_date")
        .groupBy(*by)
        .agg(sum_or_null("no_of_bins_tipped").alias("bins"))
    )


def tipped_by_site(tipped: DataFrame, bounds: Bounds, seasons: Sequence[int]) -> DataFrame:
    """Bins tipped to date: one row per packing site, one column per season, and a Total row."""
    by_site = _tipped_to_date(tipped, bounds, "season", "packing_site")
    wide = pivot_wider(by_site, ["packing_site"], "season", "bins", seasons)
    return with_total_row(wide, "packing_site", [str(s) for s in seasons])


def tipped_total(tipped: DataFrame, bounds: Bounds) -> DataFrame:
    return _tipped_to_date(tipped, bounds, "season")


def tipped_growth(tipped: DataFrame, bounds: Bounds, current: int, prior: int) -> DataFrame:
    bins = F.col("bins").cast("double")
    pair = tipped_total(tipped, bounds).agg(_of(current, bins).alias("b1"), _of(prior, bins).alias("b0"))
    return pair.select(ratio(F.col("b1") - F.col("b0"), "b0").alias("growth"))
