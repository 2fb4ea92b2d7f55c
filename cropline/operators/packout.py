"""Packout (the share of input that is not rejected), its totals and its decline with storage time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cropline.functions.aggregates import sum_or_null, sum_or_zero
from cropline.functions.scalars import (
    date_in_year,
    days_between,
    is_finite,
    is_known,
    iso_week,
    plus_days,
    ratio,
    t_quantile,
)
from cropline.operators.bounds import season_to_date, with_packout

Bounds = DataFrame


def packout_by_batch(batches: DataFrame, site: str, closed_only: bool = False) -> DataFrame:
    """Batches of one site with storage days, packout and ISO pack week."""
    batches = batches.filter(F.col("pack_site") == site)
    if closed_only:
        batches = batches.filter(F.col("batch_closed") == 1)
    return (
        with_packout(batches)
        .withColumn("storage_days", days_between("harvest_date", "pack_date"))
        .withColumn("iso_week", iso_week("pack_date"))
    )


def known_packout(batches: DataFrame) -> DataFrame:
    """Batches whose packout is neither null nor NaN; reject without input (infinite packout) stays."""
    return batches.filter(is_known("packout"))


def packout_scatter(batches: DataFrame, season: int) -> DataFrame:
    return known_packout(batches.filter(F.col("season") == season)).select("pack_date", "packout")


def packout_aggregate(
    batches: DataFrame, bounds: Bounds | None, upper: str = "lt", seasons: Sequence[int] | None = None
) -> DataFrame:
    """Packout of season sums over batches with a known packout, from first pack to close.

    ``bounds=None`` sums whole seasons to now.
    """
    if seasons is not None:
        batches = batches.filter(F.col("season").isin(list(seasons)))
    to_date = season_to_date(known_packout(batches), bounds, "pack_date", lower="first_pack", upper=upper)
    return (
        to_date.groupBy("season")
        .agg(sum_or_null("input_kgs").alias("input_kgs"), sum_or_null("reject_kgs").alias("reject_kgs"))
        .withColumn("packout", 1 - ratio("reject_kgs", "input_kgs"))
    )


def packout_to_date(batches: DataFrame, month_day: str | None = None, days: int | None = None) -> DataFrame:
    """``packout_aggregate`` within the bounds of the same batches, in one pass over them.

    Batches are folded to (season, pack date) first; the season's first pack date and its close are
    then read off those few rows. Exactly one of ``month_day`` and ``days`` sets the close.
    """
    if (month_day is None) == (days is None):
        raise ValueError("give exactly one of month_day and days")
    first = F.min("pack_date").over(Window.partitionBy("season"))
    close = date_in_year("season", month_day) if month_day is not None else plus_days("first_pack", days)
    daily = (
        known_packout(batches)
        .groupBy("season", "pack_date")
        .agg(F.sum("input_kgs").alias("input_kgs"), F.sum("reject_kgs").alias("reject_kgs"))
        .withColumn("first_pack", first)
        .filter((F.col("pack_date") >= F.col("first_pack")) & (F.col("pack_date") < close))
    )
    return (
        daily.groupBy("season")
        .agg(F.sum("input_kgs").alias("input_kgs"), F.sum("reject_kgs").alias("reject_kgs"))
        .withColumn("packout", 1 - ratio("reject_kgs", "input_kgs"))
    )


def packout_population(batches: DataFrame, bounds: Bounds) -> DataFrame:
    """Season input, reject and packout over all sites, missing weights counted as 0."""
    return (
        season_to_date(batches, bounds, "pack_date", lower="first_pack", upper="lt")
        .groupBy("season")
        .agg(sum_or_zero("input_kgs").alias("input_kgs"), sum_or_zero("reject_kgs").alias("reject_kgs"))
        .withColumn("packout", 1 - ratio("reject_kgs", "input_kgs"))
    )


def storage_day_cap(batches: DataFrame, season: int, plain: DataFrame | None = None) -> DataFrame:
    """Batches stored no longer than the longest-stored batch of ``season``.

    Where ``batches`` repeats a batch per sample line, ``plain`` is the same with one row per batch: the maximum is
    found there, and Catalyst drops the joins that only add weights.
    """
    longest = (batches if plain is None else plain).filter(F.col("season") == season).agg(F.max("storage_days"))
    return batches.filter(F.col("storage_days") <= longest.scalar())


def storage_day_profile(batches: DataFrame) -> DataFrame:
    """Count, mean and squared deviation of finite packouts by season and storage day."""
    y = F.when(is_finite("packout"), F.col("packout"))
    return (
        batches.filter(F.col("storage_days").isNotNull())
        .groupBy("season", "storage_days")
        .agg(F.count(y).alias("n"), F.avg(y).alias("mean"), (F.var_pop(y) * F.count(y)).alias("dev"))
    )


def packout_regression(batches: DataFrame, cap_season: int | None = None) -> DataFrame:
    """Least squares of packout on storage days, one line per season.

    Slopes and intercepts equal those of the model with a season interaction. Standard errors use
    that model's residual variance, pooled over the seasons. ``sd_resid`` is the season's own residual
    deviation. Rows without a finite packout do not take part.

    With ``cap_season``, only batches stored no longer than that season's longest-stored batch count,
    as after ``storage_day_cap``. The batches are folded to (season, storage day) in one pass; the cap
    and the fit are worked out on those few rows, over which the unpartitioned windows run.
    """
    every = Window.partitionBy()
    days = storage_day_profile(batches)
    if cap_season is not None:
        cap = F.max(F.when(F.col("season") == cap_season, F.col("storage_days"))).over(every)
        days = days.withColumn("cap", cap).filter(F.col("storage_days") <= F.col("cap"))
    x, n, mean = F.col("storage_days").cast("double"), F.col("n"), F.col("mean")
    within = Window.partitionBy("season")
    total = F.sum(n).over(within)
    centred = (
        days.filter(n > 0)
        .withColumn("mean_days", F.sum(n * x).over(within) / total)
        .withColumn("mean_packout", F.sum(n * mean).over(within) / total)
    )
    dx, dy = x - F.col("mean_days"), mean - F.col("mean_packout")
    sums = centred.groupBy("season").agg(
        F.sum(n).alias("n"),
        F.max("mean_days").alias("mean_days"),
        F.max("mean_packout").alias("mean_packout"),
        F.sum(n * dx * dx).alias("sxx"),
        F.sum(n * dx * dy).alias("sxy"),
        F.sum(F.col("dev") + n * dy * dy).alias("syy"),
        F.min("storage_days").alias("min_days"),
        F.max("storage_days").alias("max_days"),
    )
    fits = sums.withColumn("slope", ratio("sxy", "sxx")).withColumn(
        "intercept", F.col("mean_packout") - F.col("slope") * F.col("mean_days")
    )
    sse = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    pooled = ratio(F.sum("sse").over(every), F.sum("n").over(every) - 2 * F.count("slope").over(every))
    leverage = ratio(F.lit(1), "n") + ratio(F.col("mean_days") * F.col("mean_days"), "sxx")
    return (
        fits.withColumn("sse", sse)
        .withColumn("variance", pooled)
        .select(
            "season", "n", "intercept", "slope",
            F.sqrt(F.col("variance") * leverage).alias("se_intercept"),
            F.sqrt(ratio("variance", "sxx")).alias("se_slope"),
            "mean_days", "sxx", "min_days", "max_days",
            F.sqrt(ratio("sse", F.col("n") - 2)).alias("sd_resid"),
        )
    )


def trend_line(regression: DataFrame, step: int = 1, level: float = 0.95) -> DataFrame:
    """Each season's line over its own range of storage days, with the band of the mean at ``level``."""
    # One quantile per season, before its days are listed.
    regression = regression.withColumn("quantile", t_quantile(F.col("n") - 2, 0.5 + level / 2))
    x = F.col("storage_days").cast("double")
    grid = regression.withColumn("storage_days", F.explode(F.sequence("min_days", "max_days", F.lit(step))))
    offset = x - F.col("mean_days")
    se = F.col("sd_resid") * F.sqrt(ratio(F.lit(1), "n") + ratio(offset * offset, "sxx"))
    half = F.col("quantile") * F.col("se_fit")
    return (
        grid.withColumn("fit", F.col("intercept") + F.col("slope") * x)
        .withColumn("se_fit", se)
        .select("season", "storage_days", "fit", "se_fit", (F.col("fit") - half).alias("lower"),
                (F.col("fit") + half).alias("upper"))
    )


def slope_ratio(regression: DataFrame, season: int, reference: int) -> DataFrame:
    """Loss per storage day of one season over another's."""
    slopes = regression.agg(
        F.max(F.when(F.col("season") == season, F.col("slope"))).alias("a"),
        F.max(F.when(F.col("season") == reference, F.col("slope"))).alias("b"),
    )
    return slopes.select(ratio("a", "b").alias("ratio"))
