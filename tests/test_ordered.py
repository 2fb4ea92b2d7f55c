"""Row numbers and running totals next to the plain windows that see all rows of a group in one task."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cropline.functions.aggregates import running_sum
from cropline.operators import ordered


@pytest.fixture
def one_season(spark):
    """Nine rows in ten lie in one season, every value is there several times, and some are null."""
    draw = random.Random(7)
    rows = [(2024 if draw.random() < 0.9 else draw.choice([None, 2023, 2025]), draw.randrange(300), i,
             None if i == 2_900 else draw.randrange(50)) for i in range(3_000)]
    return spark.createDataFrame(rows, "season int, day int, id int, bins int").repartition(6)


def test_row_index_is_the_row_number(spark, rows_of, one_season, tmp_path):
    got = ordered.row_index(one_season, [F.col("day").desc(), F.col("id")], "place", str(tmp_path / "rows"))
    want = one_season.withColumn("place", F.row_number().over(Window.orderBy(F.col("day").desc(), "id")).cast("bigint"))
    assert rows_of(got) == rows_of(want)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_equal_rows_get_places_next_to_each_other(spark, tmp_path):
    df = spark.createDataFrame([(1,)] * 40 + [(None,)] * 3 + [(2,)], "x int")
    places = ordered.row_index(df, ["x"], "place", str(tmp_path / "rows")).collect()
    assert sorted(r.place for r in places) == list(range(1, 45))
    assert {r.place for r in places if r.x is None} == {1, 2, 3} and [r.place for r in places if r.x == 2] == [44]


def test_empty_frame(spark, tmp_path):
    df = spark.createDataFrame([], "x int, y int")
    assert ordered.row_index(df, ["x"], "place", str(tmp_path / "a")).collect() == []
    assert ordered.running_total(df, "y", ["x"], ["y"], "total", str(tmp_path / "b")).collect() == []


def test_running_total_is_the_window_and_spreads_one_group(spark, rows_of, one_season, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or these few rows are one range
    order = ["day", "id"]
    got = ordered.running_total(one_season, "bins", ["season"], order, "total", str(tmp_path / "rows"))
    want = one_season.withColumn("total", running_sum("bins", "season", F.struct(*order)))
    assert rows_of(got) == rows_of(want)
    assert got.filter("season = 2024 and total is null").count() > 0  # null from the first null on
    ranges = ordered.in_ranges(one_season, ["season", *order], str(tmp_path / "ranges")).filter("season = 2024")
    sizes = [r["count"] for r in ranges.groupBy("__range").count().collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) >= 3 and max(sizes) < 0.6 * sum(sizes)
