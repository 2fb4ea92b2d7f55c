"""Per-fruit sizer measurements: the largest table, filtered at the scan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropline.functions.scalars import not_in, season_label
from cropline.operators.relational import pick
from cropline.plans.dimensions import Tables

# Grades and sizes that are not packed fruit, the least plausible diameter in
# millimetres, and the season given to measurements outside the listed seasons.
EXCLUDED_GRADES = (
    "Low Colour", "Leaf", "Doub", "Doubles", "Capt", "Capture", "Class 1.5", "Reject/Spoilt", "Recycle", "Juice",
    "1.5",
)
EXCLUDED_SIZE = "Rejects"
MIN_DIAMETER = 30
OTHER_SEASON = 2021


def _season_window(season: int, month_day: str | None) -> Column:
    """Start of the year to midnight of the close day, or the whole year.

    Bounds are text so that Spark casts them, not the column, and the range reaches the scan.
    """
    start = F.col("START_TIME")
    if month_day is None:
        return (start >= f"{season}-01-01 00:00:00") & (start < f"{season + 1}-01-01 00:00:00")
    return (start > f"{season}-01-01 00:00:00") & (start <= f"{season}{month_day} 00:00:00")


def fruit_measurements(
    t: Tables,
    seasons: Sequence[int],
    month_day: str | None = None,
    other_season: int = OTHER_SEASON,
) -> DataFrame:
    """Plausible fruit of packed grades in the given seasons, up to the close day if ``month_day`` is given."""
    measured = (
        t["STG_COMPAC_BATCH"]
        .filter(reduce(or_, [_season_window(s, month_day) for s in seasons]))
        .filter(not_in("SIZER_GRADE_NAME", EXCLUDED_GRADES, keep_null=False))
        .filter(F.col("SIZE_NAME") != EXCLUDED_SIZE)
        .filter((F.col("MINOR") > MIN_DIAMETER) & (F.col("MAJOR") > MIN_DIAMETER))
    )
    return pick(
        measured.withColumn("season", season_label("START_TIME", min(seasons), max(seasons), other_season)),
        season="season", batch_id="BATCH_ID", grower_name="GROWER_NAME", grower_code="GROWER_CODE", minor="MINOR",
        major="MAJOR", weight="WEIGHT", volume="VOLUME", size_name="SIZE_NAME", grade="SIZER_GRADE_NAME",
        start_time="START_TIME",
    ).withColumn("elongation", F.col("major") / F.col("minor"))
