import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cropline.functions import aggregates as agg
from cropline.functions import scalars as sc


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[1]}" for k, v in values.items())
    return spark.createDataFrame([tuple(v[0] for v in values.values())], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("x, y, want", [
    (1.0, 4.0, 0.25), (1.0, 0.0, math.inf), (-1.0, 0.0, -math.inf), (None, 0.0, None), (1.0, None, None), (0.0, 5.0, 0.0),
])
def test_ieee_div(spark, x, y, want):
    assert one(spark, sc.ieee_div("x", "y"), x=(x, "double"), y=(y, "double")) == want


def test_ieee_div_zero_by_zero_is_nan(spark):
    assert math.isnan(one(spark, sc.ieee_div("x", "y"), x=(0.0, "double"), y=(0.0, "double")))


def test_known_keeps_infinity_and_finite_does_not(spark):
    df = spark.createDataFrame([(None,), (math.nan,), (math.inf,), (1.0,)], "x double")
    assert df.filter(sc.is_known("x")).count() == 2
    assert df.filter(sc.is_finite("x")).count() == 1


def test_exclusion_list_null_rule(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert df.filter(sc.not_in("x", ["a"], keep_null=False)).count() == 1
    assert df.filter(sc.not_in("x", ["a"], keep_null=True)).count() == 2
    assert df.filter(sc.not_in("x", [], keep_null=True)).count() == 3


def test_season_text_that_is_no_number_becomes_null(spark):
    assert one(spark, sc.to_int("x"), x=("trial", "string")) is None
    assert one(spark, sc.to_int("x"), x=("2024", "string")) == 2024


def test_move_to_year_keeps_leap_day(spark):
    assert one(spark, sc.move_to_year("x", 2024), x=(dt.date(2020, 2, 29), "date")) == dt.date(2024, 2, 29)
    with pytest.raises(ValueError):
        sc.move_to_year("x", 2023)


def test_season_label(spark):
    stamps = [dt.datetime(y, 1, 1) for y in (2020, 2022, 2025, 2026)]
    df = spark.createDataFrame([(s,) for s in stamps], "ts timestamp_ntz")
    got = [r[0] for r in df.select(sc.season_label("ts", 2022, 2025, 2021)).collect()]
    assert got == [2021, 2022, 2025, 2021]


def test_dates(spark):
    d = (dt.date(2024, 12, 30), "date")
    assert one(spark, sc.iso_week("d"), d=d) == 1
    assert one(spark, sc.plus_days("d", 7), d=d) == dt.date(2025, 1, 6)
    assert one(spark, sc.date_in_year(F.lit(2025), "-04-20"), d=d) == dt.date(2025, 4, 20)
    assert one(spark, sc.long_date_text("d"), d=d) == "30 December 2024"


def test_display_text(spark):
    assert one(spark, sc.percent_text("x"), x=(0.12345, "double")) == "12.3%"
    assert one(spark, sc.percent_text("x", 2), x=(None, "double")) is None
    assert one(spark, sc.thousands_text("x"), x=(1234567, "bigint")) == "1,234,567"


# Printed quantiles of Student's t.
@pytest.mark.parametrize("df, level, want", [
    (1, 0.975, 12.7062047361747), (2, 0.975, 4.30265272974946), (3, 0.975, 3.18244630528371), (5, 0.975, 2.57058183563631),
    (10, 0.95, 1.81246112281168), (10, 0.975, 2.22813885198627), (10, 0.995, 3.16927267261695), (30, 0.975, 2.04227245630124),
])
def test_t_quantile(spark, df, level, want):
    assert one(spark, sc.t_quantile("n", level), n=(df, "bigint")) == pytest.approx(want, abs=1e-9)


def within(t, df):
    """P(|T| <= t) for whole degrees of freedom: a finite sum over powers of the cosine, no beta function."""
    angle = math.atan(t / math.sqrt(df))
    total, term, k = 0.0, 1.0 if df % 2 == 0 else math.cos(angle), 1
    while (2 * k <= df) if df % 2 == 0 else (2 * k + 1 <= df):
        total += term
        term *= math.cos(angle) ** 2 * ((2 * k - 1) / (2 * k) if df % 2 == 0 else 2 * k / (2 * k + 1))
        k += 1
    return math.sin(angle) * total if df % 2 == 0 else 2 / math.pi * (angle + math.sin(angle) * total)


@pytest.mark.parametrize("level", [0.6, 0.9, 0.975, 0.9995])
def test_t_quantile_against_the_finite_sum(spark, level):
    rows = spark.createDataFrame([(n,) for n in [*range(1, 60), 101, 200, 399, 400, 1001]], "n bigint")
    for n, q in rows.select("n", sc.t_quantile("n", level)).collect():
        assert within(q, n) == pytest.approx(2 * level - 1, abs=1e-10), n


@pytest.mark.parametrize("x, a, b, want", [
    (0.0, 2.0, 3.0, 0.0), (1.0, 2.0, 3.0, 1.0), (0.25, 1.0, 1.0, 0.25), (0.3, 2.0, 1.0, 0.09), (0.3, 1.0, 2.0, 0.51),
    (0.5, 7.5, 7.5, 0.5), (0.9, 2.0, 2.0, 0.972),
])
def test_incomplete_beta(spark, x, a, b, want):
    got = one(spark, sc.incomplete_beta("x", "a", "b"), x=(x, "double"), a=(a, "double"), b=(b, "double"))
    assert got == pytest.approx(want, abs=1e-13)


@pytest.mark.parametrize("x", [0.5, 1.0, 2.0, 10.5, 170.0])
def test_log_gamma(spark, x):
    assert one(spark, sc.log_gamma("x"), x=(x, "double")) == pytest.approx(math.lgamma(x), rel=1e-13, abs=1e-13)


def test_t_quantile_without_degrees_of_freedom(spark):
    assert one(spark, sc.t_quantile("n", 0.975), n=(0, "bigint")) is None


def test_three_sum_rules(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", None), ("c", 2)], "k string, x int")
    got = df.groupBy("k").agg(agg.sum_or_null("x"), agg.sum_or_zero("x"), agg.sum_skip_null("x")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [("a", None, 1, 1), ("b", None, 0, None), ("c", 2, 2, 2)]


def test_running_sum_is_null_from_the_first_null_on(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, None), (1, 3, 4), (2, 1, 7)], "s int, d int, x int")
    got = df.select("s", "d", agg.running_sum("x", "s", "d").alias("r")).orderBy("s", "d").collect()
    assert [r["r"] for r in got] == [5, None, None, 7]


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame([(1, 3), (1, 1), (2, 9)], "s int, x int").withColumn("p", agg.share_within("x", "s"))
    assert {r["s"]: r["t"] for r in df.groupBy("s").agg(F.sum("p").alias("t")).collect()} == {1: 1.0, 2: 1.0}
