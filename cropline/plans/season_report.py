"""The season table at the top of the report."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropline.functions.aggregates import sum_or_null
from cropline.functions.scalars import date_in_year, days_between, ratio
from cropline.operators.packout import known_packout, packout_by_batch


def season_kpis(
    deliveries: DataFrame,
    tipped: DataFrame,
    batches: DataFrame,
    site: str,
    month_day: str,
    seasons: Iterable[int] | None = None,
    first_pick: int = 1,
) -> DataFrame:
    """One row per season that has batches of ``site`` with a known packout, with the figures the report quotes.

    Each source is folded once to a row per season and day (and pick). The folds are stacked; bounds are read off the
    season's rows by a window over them, and all figures come from one aggregation of the same few rows. Sums are null
    where one of their values is null, as everywhere in the report.
    """
    known = known_packout(packout_by_batch(batches, site))
    if seasons is not None:
        known = known.filter(F.col("season").isin(list(seasons)))
    packed = known.groupBy("season", F.col("pack_date").alias("day")).agg(
        F.min("harvest_date").alias("harvest_date"),
        sum_or_null("input_kgs").alias("input_kgs"), sum_or_null("reject_kgs").alias("reject_kgs"),
    )
    picked = deliveries.groupBy(
        "season", F.col("harvest_date").alias("day"), (F.col("pick_no") == first_pick).alias("first_pick"),
        F.coalesce("presize_flag", F.lit(True)).alias("presize"),
    ).agg(sum_or_null("no_of_bins").alias("bins"))
    done = tipped.groupBy("season", F.col("pack_date").alias("day")).agg(sum_or_null("no_of_bins_tipped").alias("bins"))
    folds = [df.withColumn("source", F.lit(name)) for name, df in (("packed", packed), ("picked", picked), ("tipped", done))]
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), folds)

    season = Window.partitionBy("season")
    is_packed, is_picked, is_tipped = (F.col("source") == name for name in ("packed", "picked", "tipped"))
    rows = rows.withColumns({
        "first_harvest": F.min("harvest_date").over(season), "first_pack": F.min(F.when(is_packed, F.col("day"))).over(season),
    }).withColumn("close", date_in_year("season", month_day))
    plain = is_picked & ~F.coalesce("presize", F.lit(True))

    def total(value: str, here: Column) -> Column:
        here = F.coalesce(here, F.lit(False))
        return F.when((F.count_if(here) > 0) & (F.count_if(here & F.col(value).isNull()) == 0), F.sum(F.when(here, F.col(value))))

    in_pack = is_packed & (F.col("day") >= F.col("first_pack")) & (F.col("day") < F.col("close"))
    harvested = F.when(plain, F.col("day"))
    figures = rows.filter(F.col("season").isNotNull() & F.col("first_pack").isNotNull()).groupBy("season").agg(
        F.min("first_harvest").alias("first_harvest"), F.max(harvested).alias("last_harvest"),
        F.min("first_pack").alias("first_pack"), F.max("close").alias("close"),
        days_between(F.min(harvested), F.max(harvested)).alias("harvest_days"),
        total("bins", plain).alias("whole"),
        total("bins", plain & F.col("day").between(F.col("first_harvest"), F.col("close"))).alias("bins"),
        total("bins", is_picked).alias("every"), total("bins", is_picked & F.col("first_pick")).alias("first"),
        total("bins", is_tipped & (F.col("day") <= F.col("close"))).alias("bins_tipped"),
        total("input_kgs", in_pack).alias("input_kgs"), total("reject_kgs", in_pack).alias("reject_kgs"),
    )
    return figures.select(
        "season", "first_harvest", "last_harvest", "first_pack", days_between("first_pack", "close").alias("days_packing"),
        "bins", ratio("whole", "harvest_days").alias("bins_per_day"), ratio("first", "every").alias("first_pick_share"),
        "bins_tipped", (1 - ratio("reject_kgs", "input_kgs")).alias("packout"),
    )
