"""Landed layouts: buckets, seasons and months that are replaced, footers, pruned folders. And joins of rows without a key."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from cropline.operators import relational as rel
from cropline.operators import size as sz
from cropline.operators.bounds import land_bounds, season_to_date
from cropline.plans import harvest_data, packing_data
from cropline.sources import sinks
from cropline.sources.buckets import attach, land_bucketed, over_parts
from cropline.sources.tables import footer_extent, land, read_for_footers


def executed(df):
    """The plan after the rows were worked out."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def final(plan):
    return plan.split("== Initial Plan ==")[0]


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# --- buckets -----------------------------------------------------------------------------------------------------------

@pytest.fixture
def busy_tables(spark, tables):
    """Bins of many batches, one of which has a third of them, and a third without a batch."""
    first = tables["ma_Grader_BatchT"].first()
    batches = [{**first.asDict(), "GraderBatchID": i} for i in range(40)]
    bins = [(i, i % 7, 3 if i % 3 == 0 else None if i % 3 == 1 else i % 40) for i in range(900)]
    return {
        **tables, "ma_Grader_BatchT": spark.createDataFrame(batches, tables["ma_Grader_BatchT"].schema),
        "ma_BinT": spark.createDataFrame(bins, "BinID bigint, BinDeliveryID bigint, GraderBatchID bigint").select(
            *[F.col(f.name).cast(f.dataType) for f in tables["ma_BinT"].schema]),
    }


KEYS = {"ma_BinT": "GraderBatchID", "ma_Grader_BatchT": "GraderBatchID"}


@pytest.mark.parametrize("plan", [packing_data.bins_tipped, harvest_data.bins_for_grader_batch, packing_data.grader_batch_detail])
def test_buckets_give_the_same_rows(busy_tables, rows_of, tmp_path, plan):
    landed = land_bucketed(busy_tables, KEYS, str(tmp_path), f"b{plan.__name__}", buckets=4, hot_rows=100)
    assert rows_of(over_parts(landed, plan)) == rows_of(plan(busy_tables))
    bins = landed.frequent["ma_BinT"]
    assert {r[0] for r in bins.select("GraderBatchID").distinct().collect()} == {3, None}
    assert landed.even["ma_BinT"].filter("GraderBatchID = 3 or GraderBatchID is null").isEmpty()


def test_bins_and_batches_meet_without_a_shuffle(spark, busy_tables, tmp_path, no_broadcast):
    landed = land_bucketed(busy_tables, KEYS, str(tmp_path), "plain", buckets=4, hot_rows=100)
    bins, batches = landed.even["ma_BinT"], landed.even["ma_Grader_BatchT"]
    counted = bins.groupBy("GraderBatchID").agg(F.count("BinID").alias("n"))
    plan = final(executed(batches.select("GraderBatchID", "PackDate").join(counted, "GraderBatchID")))
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
    again = attach(spark, "plain_again", bins, f"{tmp_path}/even/ma_BinT", "GraderBatchID", 4)
    plan = final(executed(batches.select("GraderBatchID").join(again, "GraderBatchID")))
    assert "SortMergeJoin" in plan and "Exchange" not in plan


# --- pruned folders ----------------------------------------------------------------------------------------------------

def test_bounds_prune_the_seasons_that_were_landed(spark, rows_of, tmp_path):
    rows = spark.createDataFrame(
        [(s, dt.date(s, 1, 1) + dt.timedelta(d), d) for s in range(2015, 2026) for d in range(0, 200, 5)] + [(None, dt.date(2025, 3, 3), 1)],
        "season int, pack_date date, n int")
    facts = land(rows, str(tmp_path / "facts"), by="season")
    packed = spark.createDataFrame([(2024, dt.date(2024, 2, i)) for i in range(3, 9)] + [(2025, dt.date(2025, 3, 1))], "season int, pack_date date")
    bounds = packed.groupBy("season").agg(F.min("pack_date").alias("first_pack")).withColumn("close", F.date_add("first_pack", 30))
    later = bounds.withColumn("close", F.date_sub("close", 3))  # the same seasons again, for a shorter time
    limits = land_bounds(bounds.unionByName(later), str(tmp_path / "bounds"))
    assert limits.count() == 2
    kept = season_to_date(facts, limits, "pack_date", lower="first_pack", landed=True)
    want = rows_of(season_to_date(rows, bounds, "pack_date", lower="first_pack"))
    assert rows_of(kept) == want and len(want) > 5
    assert rows_of(season_to_date(facts, bounds, "pack_date", lower="first_pack", landed=True)) == want
    plan = final(executed(kept))
    assert "dynamicpruning" in plan and "SubqueryBroadcast" in plan  # the broadcast of the join is what prunes
    assert "ReusedExchange" in plan and "/bounds]" not in plan  # and they are worked out once


# --- footers -----------------------------------------------------------------------------------------------------------

def test_extents_come_from_footers(spark, rows_of, tmp_path):
    rows = [(s, dt.date(s, 2, 1 + i % 20), None if i % 9 == 0 else i * s) for s in (2023, 2024, 2025) for i in range(60)]
    df = spark.createDataFrame(rows, "season int, day date, n bigint")
    sinks.write_dataset(df, str(tmp_path / "rows"))
    got = footer_extent(read_for_footers(spark, str(tmp_path / "rows")), "season", ["day", "n"])
    assert rows_of(got) == rows_of(footer_extent(df, "season", ["day", "n"]))
    plan = got._jdf.queryExecution().toString()
    assert "PushedAggregation: [COUNT(*), MIN(day), MAX(day), MIN(n), MAX(n)]" in plan and "PushedGroupBy: [season]" in plan
    assert spark.conf.get("spark.sql.sources.useV1SourceList").count("parquet") == 1


# --- runs that are repeated ----------------------------------------------------------------------------------------------

def test_a_rerun_replaces_its_seasons_and_a_failed_one_nothing(spark, rows_of, tmp_path):
    path = str(tmp_path / "rows")
    rows = spark.createDataFrame([(2023, 1), (2024, 2), (2024, 3), (2025, 4)], "season int, n int").select("n", "season")
    sinks.replace_partitions(rows, path, ["season"])
    sinks.replace_partitions(rows.filter("season = 2024 and n = 2").withColumn("n", F.lit(9)), path, ["season"])
    read = lambda: rows_of(spark.read.parquet(path).select("season", "n"))
    assert read() == [(2023, 1), (2024, 9), (2025, 4)]
    broken = rows.withColumn("n", F.when(F.col("n") == 4, F.raise_error(F.lit("bad row"))).otherwise(F.lit(0)).cast("int"))
    with pytest.raises(Exception, match="bad row"):
        sinks.replace_partitions(broken, path, ["season"])
    assert read() == [(2023, 1), (2024, 9), (2025, 4)]
    covers = rows.select("season").distinct().filter("season <> 2023")
    sinks.replace_partitions(rows.filter("season = 2025"), path, ["season"], covers=covers)
    assert read() == [(2023, 1), (2025, 4)]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_report_runs(spark, tmp_path, fmt):
    df = spark.createDataFrame([(f"site {i:02}", i) for i in range(30)], "site string, bins bigint").repartition(4)
    show = {"table": sinks.Display({"bins": "Bins", "site": "Site"}, order_by=["site"])}
    root = str(tmp_path / "report")
    for run, least in (("2025-04-13", 0), ("2025-04-20", 5), ("2025-04-20", 7)):
        sinks.write_run({"table": df.filter(F.col("bins") >= least)}, root, run, fmt, show)
    newest = sinks.read_run(spark, f"{root}/table", fmt=fmt)
    assert newest.columns == ["Bins", "Site"] and [r.Site for r in newest.collect()] == [f"site {i:02}" for i in range(7, 30)]
    assert sinks.read_run(spark, f"{root}/table", "2025-04-13", fmt).count() == 30


# --- moments -------------------------------------------------------------------------------------------------------------

def fruit(spark, n=600, offset=0.0):
    draw = random.Random(5)
    rows = [(draw.choice([2024, 2025]), dt.datetime(2025, draw.randrange(1, 5), draw.randrange(1, 28), 7), *(
        None if draw.random() < 0.05 else offset + draw.gauss(50, 5) for _ in range(5))) for _ in range(n)]
    rows.append((2023, dt.datetime(2025, 1, 1), 40.0, 41.0, 1.02, None, None))
    return spark.createDataFrame(rows, "season int, start_time timestamp, minor double, major double, elongation double, weight double, volume double")


def alike(got, want, **within):
    got, want = ({r["season"]: r for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys()
    for season, row in want.items():
        for column in row.asDict():
            if row[column] is None:
                assert got[season][column] is None
            else:
                assert got[season][column] == pytest.approx(row[column], **within), (season, column)


@pytest.mark.parametrize("offset, near", [(0.0, 1e-11), (1e6, 1e-7)])
def test_moments_of_days_are_those_of_one_pass(spark, tmp_path, offset, near):
    df = fruit(spark, offset=offset)
    folder = str(tmp_path / "moments")
    sz.land_moment_days(df.filter("start_time < '2025-03-10'"), folder)
    sz.land_moment_days(df, folder, since="2025-03-08")
    sz.land_moment_days(df, folder, since="2025-03-08")
    alike(sz.moments_of_parts(spark.read.parquet(folder)), sz.size_moments(df), rel=near, abs=near)


def test_merged_parts_can_be_merged_again(spark):
    df = fruit(spark).withColumn("day", F.to_date("start_time")).withColumn("week", F.weekofyear("day"))
    weeks = sz.merge_parts(sz.moment_parts(df, ["season", "week", "day"]), ["season", "week"])
    alike(sz.moments_of_parts(weeks), sz.size_moments(df), rel=1e-11)


def test_a_later_run_reads_only_its_months(spark, tmp_path):
    fruit(spark).write.parquet(str(tmp_path / "fruit"))
    stored = spark.read.parquet(str(tmp_path / "fruit"))
    late = stored.filter(F.col("start_time") >= F.lit("2025-03-01 00:00:00"))
    assert "GreaterThanOrEqual(start_time" in sz.moment_parts(late, ["season"])._jdf.queryExecution().toString()


# --- default edges -------------------------------------------------------------------------------------------------------

def test_default_edges(spark):
    draw = random.Random(9)
    values = [draw.uniform(3, 9) for _ in range(400)] + [3.0, 9.0]
    rows = sz.default_histogram(spark.createDataFrame([(v,) for v in [*values, None]], "v double"), "v").orderBy("bin").collect()
    width = (max(values) - min(values)) / 29
    assert len(rows) == 30 and sum(r["count"] for r in rows) == 402
    assert rows[0].low == pytest.approx(min(values) - width / 2) and rows[-1].high == pytest.approx(max(values) + width / 2)
    for r in rows:
        assert r["count"] == sum(r.low < v <= r.high for v in values)


def test_default_edges_close_bins_above(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 1, 2, 4, 5)], "v double")
    rows = sz.default_histogram(df, "v", bins=6).orderBy("bin").collect()
    assert [(r.low, r.high, r["count"]) for r in rows] == [(i - 0.5, i + 0.5, n) for i, n in enumerate((1, 2, 1, 0, 1, 1))]
    half = sz.default_histogram(df.select((F.col("v") / 2).alias("v")), "v", bins=3).orderBy("bin").collect()
    assert [r["count"] for r in half] == [3, 1, 2]  # edges -0.625, 0.625, 1.875, 3.125


@pytest.mark.parametrize("values, want", [([], []), ([None], []), ([7.0, 7.0], [2])])
def test_default_edges_without_a_range(spark, values, want):
    rows = sz.default_histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()
    assert [r["count"] for r in rows] == want and all(math.isclose(r.high - r.low, 0.1) and r.low <= 7 <= r.high for r in rows)


def test_default_edges_read_the_source_once(spark, tmp_path):
    spark.createDataFrame([(float(i % 50),) for i in range(500)], "v double").write.parquet(str(tmp_path / "v"))
    plan = final(executed(sz.default_histogram(spark.read.parquet(str(tmp_path / "v")), "v")))
    assert "ReusedExchange" in plan or plan.count("FileScan parquet") == 1


# --- rows without a key --------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_null_spread_join(spark, rows_of, how):
    draw = random.Random(1)
    key = lambda: None if draw.random() < 0.5 else draw.randrange(6)
    left = spark.createDataFrame([(key(), key(), i % 300) for i in range(400)], "a int, b int, x int")
    right = spark.createDataFrame([(key(), draw.choice([None, 1, 2]), i) for i in range(12)], "a int, b int, y int")
    for keys in (["a"], ["a", "b"]):
        other = right if len(keys) == 2 else right.drop("b")
        got = rel.join_null_spread(left, other, keys, how, rows_per_task=20)
        assert got.columns == rel.join_null_safe(left, other, keys, how).columns
        assert rows_of(got) == rows_of(rel.join_null_safe(left, other, keys, how))
    with pytest.raises(ValueError):
        rel.join_null_spread(left, right, ["a"], "full")


def test_rows_without_a_key_lie_over_many_tasks(spark, no_broadcast):
    left = spark.createDataFrame([(i // 2 if i % 2 else None, i) for i in range(4_000)], "k int, x int")
    right = spark.createDataFrame([(None, 0), *((i, i) for i in range(2_000))], "k int, y int")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        spread = sizes(rel.join_null_spread(left, right, ["k"], rows_per_task=50))
        together = sizes(rel.join_null_safe(left, right, ["k"]))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(spread) == sum(together) == 4_000
    assert max(spread) < 2.5 * statistics.median(spread) and max(together) > 8 * statistics.median(together)
