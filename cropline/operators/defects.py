"""Defect proportions by batch and season, and the ranking of the largest defects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cropline.functions.aggregates import sum_or_null, sum_or_zero
from cropline.functions.scalars import day_of, ieee_div, is_known
from cropline.operators.bounds import season_to_date

Bounds = DataFrame


def sample_qty_by_batch(assessments: DataFrame, bounds: Bounds | None = None) -> DataFrame:
    """Fruit sampled per batch, from first pack to close by assessment date when bounds are given."""
    dated = assessments.withColumn("assessment_date", day_of("assessed_at"))
    return (
        season_to_date(dated, bounds, "assessment_date", lower="first_pack", upper="lt")
        .groupBy("grader_batch_id")
        .agg(sum_or_zero("sample_qty").alias("sample_qty"))
    )


def _proportion():
    return ieee_div("defect_qty", "sample_qty") * ieee_div("reject_kgs", "input_kgs")


def defect_qty_by_batch(defects: DataFrame, assessments: DataFrame) -> DataFrame:
    return (
        defects.join(assessments.select("assessment_id", "grader_batch_id"), "assessment_id")
        .groupBy("grader_batch_id", "defect")
        .agg(sum_or_null("defect_qty").alias("defect_qty"))
    )


def batch_defect_proportion(
    defects: DataFrame, assessments: DataFrame, samples: DataFrame, batches: DataFrame, drop: str = "prop"
) -> DataFrame:
    """Share of a batch lost to a defect: (defects / fruit sampled) x (reject / input).

    ``drop="prop"`` removes rows without a known proportion, ``drop="input"`` rows without input
    weight. Either way a row without a batch goes, so assessments without a batch need no
    null-matching join and the batch join can be an inner one.
    """
    if drop not in ("prop", "input"):
        raise ValueError(f"drop must be 'prop' or 'input', not {drop!r}")
    rows = (
        defect_qty_by_batch(defects, assessments)
        .join(samples, "grader_batch_id")
        .join(batches.select("grader_batch_id", "season", "pack_date", "input_kgs", "reject_kgs"), "grader_batch_id")
        .withColumn("prop", _proportion())
    )
    return rows.filter(is_known("prop") if drop == "prop" else F.col("input_kgs").isNotNull())


def defect_profile(proportions: DataFrame, bounds: Bounds) -> DataFrame:
    """The same proportion on sums by season and defect, from first pack to close.

    A defect's denominators cover only the batches in which it was found.
    """
    return (
        season_to_date(proportions, bounds, "pack_date", lower="first_pack", upper="lt")
        .groupBy("season", "defect")
        .agg(*[sum_or_null(c).alias(c) for c in ("defect_qty", "sample_qty", "input_kgs", "reject_kgs")])
        .withColumn("prop", _proportion())
    )


def top_defects(profile: DataFrame, season: int, n: int = 15) -> DataFrame:
    """Profile rows of the ``n`` largest defects of ``season``, in every season, with their rank (1 = largest).

    Missing proportions sort as largest and ties go to the later name, as in the published order.
    The ranking is a window over the profile itself, so the profile is computed once.
    """
    order = Window.partitionBy("season").orderBy(
        F.when(is_known("prop"), F.col("prop")).desc_nulls_first(), F.col("defect").desc()
    )
    current = F.when(F.col("season") == season, F.row_number().over(order))
    return (
        profile.withColumn("current_rank", current)
        .withColumn("rank", F.max("current_rank").over(Window.partitionBy("defect")))
        .filter(F.col("rank") <= n)
        .drop("current_rank")
    )
