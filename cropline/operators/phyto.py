"""Pest interceptions by lot and season."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cropline.functions.aggregates import sum_or_null, sum_or_zero
from cropline.functions.scalars import day_of, days_between, not_in, ratio
from cropline.operators.bounds import season_to_date

Bounds = DataFrame

# Pest codes that do not count as an interception.
EXCLUDED_PESTS = ("LLT", "ROT009")


def phyto_lot_summary(findings: DataFrame, lots: DataFrame) -> DataFrame:
    """Findings summed by lot, defect and pest code, with the lot's detail."""
    return (
        findings.groupBy("lot_id", "defect", "mkt_defect_code")
        .agg(
            F.max("season").alias("season"),
            sum_or_zero("defect_qty").alias("defect_qty"),
            sum_or_zero("sample_qty").alias("sample_qty"),
        )
        .join(lots, "lot_id")
    )


def with_requirements(summary: DataFrame, requirements: DataFrame) -> DataFrame:
    """Lot findings that the lot's own requirements cover, with storage days."""
    return summary.join(requirements, ["lot_id", "mkt_defect_code"]).withColumn(
        "storage_days", days_between("harvest_date", "pack_date")
    )


def interception_rate(
    findings: DataFrame, lots: DataFrame, bounds: Bounds | None = None, exclude: Sequence[str] = EXCLUDED_PESTS
) -> DataFrame:
    """Lots with a counted pest over all lots, by season, to the close date if bounds are given.

    ``findings`` is the output of ``with_requirements``. A finding without a code is kept by the
    exclusion list. The distinct count is aggregated by lot before it is aggregated by season.
    """
    counted = findings.filter(not_in("mkt_defect_code", exclude, keep_null=True))
    hit = (
        season_to_date(counted, bounds, "pack_date")
        .groupBy("season", "lot_id")
        .agg(F.count(F.lit(1)).alias("findings"))
        .groupBy("season")
        .agg(F.count(F.lit(1)).alias("with_interceptions"))
    )
    total = season_to_date(lots, bounds, "pack_date").groupBy("season").agg(F.count(F.lit(1)).alias("total"))
    return hit.join(total, "season").withColumn("rate", ratio("with_interceptions", "total"))


def pest_counts(findings: DataFrame, lots: DataFrame, bounds: Bounds | None) -> DataFrame:
    """Pest quantity by season and defect, by assessment date up to the close date.

    A finding counts once for each row that ``lots`` (the lot table is enough) has of its lot, and once where it has
    none. Findings are summed by lot before they meet the counts, so those without a lot are few rows by then.
    """
    dated = findings.withColumn("assessment_date", day_of("assessed_at"))
    by_lot = (
        season_to_date(dated, bounds, "assessment_date")
        .groupBy("season", "lot_id", "defect")
        .agg(sum_or_null("defect_qty").alias("defect_qty"))
    )
    repeated = lots.groupBy("lot_id").agg(F.count(F.lit(1)).alias("__copies")).filter("__copies > 1")
    return (
        by_lot.join(repeated, "lot_id", "left")
        .withColumn("defect_qty", F.col("defect_qty") * F.coalesce("__copies", F.lit(1)))
        .groupBy("season", "defect")
        .agg(sum_or_null("defect_qty").alias("defect_qty"))
    )


def order_by_season(df: DataFrame, season: int, key: str, value: str) -> DataFrame:
    """Add each key's ascending rank by value in a reference season; null for keys absent there.

    ``df`` is a report table with one row per season and key.
    """
    order = Window.partitionBy("season").orderBy(F.col(value).asc_nulls_last(), F.col(key))
    reference = F.when(F.col("season") == season, F.row_number().over(order))
    return (
        df.withColumn("reference_rank", reference)
        .withColumn("rank", F.max("reference_rank").over(Window.partitionBy(key)))
        .drop("reference_rank")
    )
