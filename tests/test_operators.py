import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cropline.operators import bounds as bnd
from cropline.operators import defects as dfc
from cropline.operators import harvest as hv
from cropline.operators import packout as po
from cropline.operators import phyto as ph
from cropline.operators import size as sz
from cropline.plans import fruit_data, harvest_data, packing_data, phyto_data, quality_data
from cropline.plans.season_report import season_kpis
from tests.fixtures import SITE, day

MD = "-04-20"


@pytest.fixture(scope="module")
def batches(tables):
    return packing_data.grader_batch_detail(tables)


@pytest.fixture(scope="module")
def bounds(batches):
    return bnd.season_bounds(batches, SITE, month_day=MD)


@pytest.fixture(scope="module")
def deliveries(tables):
    return harvest_data.bins_harvested_pick(tables)


# --- bounds ---

def test_bounds_skip_unknown_packouts_but_keep_infinite_ones(bounds):
    # Batches 3 (waste unknown) and 4 (0/0) start earlier and do not count; batch 5 (x/0) would.
    assert [tuple(r) for r in sorted(bounds.collect())] == [
        (2024, day("2024-02-15"), day("2024-03-01"), day("2024-04-20")),
        (2025, day("2025-02-10"), day("2025-03-02"), day("2025-04-20")),
    ]


def test_bounds_by_week(batches, rows_of):
    week = bnd.season_bounds(batches, SITE, days=7)
    assert rows_of(week, "season", "close") == [(2024, day("2024-03-08")), (2025, day("2025-03-09"))]
    with pytest.raises(ValueError):
        bnd.season_bounds(batches, SITE)


def test_bounds_of_another_source_count_every_batch(tables, rows_of):
    every = bnd.season_bounds(packing_data.grader_batch_dates(tables), month_day=MD, seasons=[2024])
    assert rows_of(every) == [(2024, day("2024-02-01"), day("2024-02-20"), day("2024-04-20"))]


@pytest.mark.parametrize("lower", [None, "first_pack", "first_harvest"])
@pytest.mark.parametrize("upper", ["le", "lt"])
def test_a_season_listed_twice_counts_once(batches, bounds, rows_of, lower, upper):
    once = bnd.season_to_date(batches, bounds, "pack_date", lower, upper)
    later = bounds.withColumns({"first_harvest": F.date_add("first_harvest", 2), "close": F.date_sub("close", 1)})
    twice = bnd.season_to_date(batches, bounds.unionByName(later), "pack_date", lower, upper)
    assert once.columns == twice.columns == batches.columns
    assert rows_of(once) == rows_of(twice) and once.count()


def test_upper_bound_rule(batches, bounds):
    def ids(upper):
        return {r["grader_batch_id"] for r in bnd.season_to_date(batches, bounds, "pack_date", "first_pack", upper).collect()}

    assert ids("le") - ids("lt") == {5, 9}
    with pytest.raises(ValueError):
        bnd.season_to_date(batches, bounds, "pack_date", upper="less")


def test_no_bounds_and_empty_bounds(batches):
    assert bnd.season_to_date(batches, None, "pack_date") is batches
    empty = bnd.season_bounds(batches, "no such site", month_day=MD)
    assert bnd.season_to_date(batches, empty, "pack_date").count() == 0


# --- harvest ---

def test_harvest_by_site(deliveries, bounds, rows_of):
    got = hv.harvest_by_site(deliveries, bounds, ["Cool store", "Unused"])
    assert got.columns == ["season", "Cool store", "Unused", "other_sites", "no_site", "total"]
    assert rows_of(got) == [(2024, 30, 0, 0, 0, 30), (2025, 85, 0, 0, 0, 85)]
    found = hv.harvest_by_site(deliveries, bounds)
    assert found.columns == ["season", "Cool store", "other_sites", "no_site", "total"]
    assert rows_of(found, "total") == [(30,), (85,)]
    more = deliveries.unionByName(deliveries.withColumn("storage_site", F.lit(None).cast("string"))).unionByName(
        deliveries.withColumn("storage_site", F.lit("Shed")))
    wide = hv.harvest_by_site(more, bounds, ["Cool store"])
    assert rows_of(wide) == [(2024, 30, 30, 30, 90), (2025, 85, 85, 85, 255)]
    assert rows_of(wide, "season", "total") == rows_of(hv.harvest_total(more, bounds))


def test_harvest_duration_and_rate(deliveries, rows_of):
    rows = rows_of(hv.harvest_duration(deliveries))
    assert (2024, day("2024-02-15"), day("2024-04-21"), 66) in rows
    rate = {r["season"]: r for r in hv.harvest_rate(deliveries).collect()}
    assert rate[2024]["bins_per_day"] == 70 / 66 and rate[None]["bins_per_day"] is None  # one harvest day
    assert {r["season"] for r in hv.harvest_rate(deliveries, [2025]).collect()} == {2025}


def test_pick_share_counts_presized_deliveries(deliveries):
    share = {(r["season"], r["pick_no"]): r["share"] for r in hv.pick_share(deliveries).collect()}
    assert share[(2024, 2)] == 20 / 86 and share[(2024, 1)] == 66 / 86 and share[(2025, 1)] == 1.0


def test_cumulative_harvest(deliveries, bounds, rows_of):
    got = hv.cumulative_harvest(deliveries, bounds, MD)
    assert rows_of(got, "season", "bins", "cum_bins", "plot_date") == [
        (2024, 10, 10, day("2024-02-15")), (2024, 20, 30, day("2024-02-16")),
        (2025, 30, 30, day("2024-02-10")), (2025, 5, 85, day("2024-04-20")), (2025, 50, 80, day("2024-02-12")),
    ]


# Published harvest curve, first days of two seasons: date, bins, running bins, plot date.
CURVE = [
    (2022, "2022-02-15", 54, 54, "2024-02-15"),
    (2022, "2022-02-16", 92, 146, "2024-02-16"),
    (2022, "2022-02-17", 64, 210, "2024-02-17"),
    (2022, "2022-02-18", 98, 308, "2024-02-18"),
    (2022, "2022-02-19", 20, 328, "2024-02-19"),
    (2022, "2022-02-21", 110, 438, "2024-02-21"),
    (2022, "2022-02-22", 125, 563, "2024-02-22"),
    (2025, "2025-02-11", 159, 159, "2024-02-11"),
    (2025, "2025-02-12", 586, 745, "2024-02-12"),
    (2025, "2025-02-13", 1002, 1747, "2024-02-13"),
    (2025, "2025-02-14", 1123, 2870, "2024-02-14"),
    (2025, "2025-02-15", 1166, 4036, "2024-02-15"),
    (2025, "2025-02-16", 763, 4799, "2024-02-16"),
    (2025, "2025-02-17", 822, 5621, "2024-02-17"),
]


def test_running_harvest_matches_the_published_curve(spark, rows_of):
    daily = spark.createDataFrame([(s, day(d), n) for s, d, n, _, _ in CURVE], "season int, harvest_date date, bins bigint")
    assert rows_of(hv.running_harvest(daily, MD)) == sorted(
        [(s, day(d), n, c, day(p)) for s, d, n, c, p in CURVE], key=repr
    )


def test_curve_is_cut_at_the_close_day_on_the_plot_axis(spark):
    daily = spark.createDataFrame(
        [(2025, day("2025-04-20"), 1), (2025, day("2025-04-21"), 1)], "season int, harvest_date date, bins bigint"
    )
    assert hv.running_harvest(daily, MD).count() == 1


def test_growth_forms(deliveries, bounds):
    got = hv.harvest_growth(hv.harvest_total(deliveries, bounds), bounds, 2025, 2024).first()
    r1, r0 = 85 / 69, 30 / 65
    assert got["growth_as_published"] == pytest.approx((r1 - r0) / (30 / 69))
    assert got["growth_consistent"] == pytest.approx((r1 - r0) / r0)
    assert got["total_growth"] == pytest.approx(55 / 30)


def test_tipped(tables, bounds, rows_of):
    tipped = packing_data.bins_tipped(tables)
    assert rows_of(hv.tipped_by_site(tipped, bounds, [2024, 2025])) == sorted([(SITE, 4, 2), ("Total", 4, 2)], key=repr)
    assert hv.tipped_growth(tipped, bounds, 2025, 2024).first()["growth"] == -0.5


# --- packout ---

def test_packout_by_batch(batches):
    rows = {r["grader_batch_id"]: r for r in po.packout_by_batch(batches, SITE).collect()}
    assert 7 not in rows
    assert rows[1]["packout"] == 1 - 125 / 1000 and rows[1]["storage_days"] == 15 and rows[1]["iso_week"] == 9
    assert rows[3]["packout"] is None and math.isnan(rows[4]["packout"]) and rows[5]["packout"] == -math.inf


def test_packout_aggregate_and_one_pass_form_agree(batches, bounds, rows_of):
    site = po.packout_by_batch(batches, SITE)
    in_bounds = rows_of(po.packout_aggregate(site, bounds))
    assert in_bounds == rows_of(po.packout_to_date(site, month_day=MD))
    assert in_bounds[0][0] == 2024 and in_bounds[0][3] == 1 - 180 / 1500
    week = bnd.season_bounds(batches, SITE, days=7)
    assert rows_of(po.packout_aggregate(site, week)) == rows_of(po.packout_to_date(site, days=7))


def test_infinite_packout_stays_in_the_sums(batches, bounds):
    site = po.packout_by_batch(batches, SITE)
    whole = {r["season"]: r for r in po.packout_aggregate(site, None).collect()}
    assert float(whole[2024]["reject_kgs"]) == 210 and float(whole[2024]["input_kgs"]) == 1500


def test_population_covers_all_sites(batches, bounds):
    rows = {r["season"]: float(r["input_kgs"]) for r in po.packout_population(batches, bounds).collect()}
    assert rows == {2024: 1500.0, 2025: 3500.0}


def test_scatter(batches, rows_of):
    assert rows_of(po.packout_scatter(po.packout_by_batch(batches, SITE), 2025), "pack_date") == [
        (day("2025-03-02"),), (day("2025-04-02"),), (day("2025-04-20"),),
    ]


@pytest.fixture(scope="module")
def stored(spark):
    rng = np.random.default_rng(3)
    rows = []
    for season, a, b in ((2022, 0.9, -0.001), (2023, 0.85, -0.002), (2024, 0.8, -0.004)):
        for d in rng.integers(0, 60, 40):
            rows.append((season, int(d), float(a + b * d + rng.normal(0, 0.01))))
    rows += [(2024, 5, -math.inf), (2024, 6, math.nan), (2024, 7, None), (2024, None, 0.5)]
    return spark.createDataFrame(rows, "season int, storage_days int, packout double"), rows


def test_regression_equals_the_interaction_model(stored):
    df, rows = stored
    clean = [r for r in rows if r[1] is not None and r[2] is not None and math.isfinite(r[2])]
    seasons = sorted({r[0] for r in clean})
    y = np.array([r[2] for r in clean])
    x = np.zeros((len(clean), 2 * len(seasons)))
    for i, (s, d, _) in enumerate(clean):
        k = seasons.index(s)
        x[i, 2 * k], x[i, 2 * k + 1] = 1, d
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    s2 = float(((y - x @ beta) ** 2).sum()) / (len(y) - x.shape[1])
    se = np.sqrt(np.diag(s2 * np.linalg.inv(x.T @ x)))
    got = {r["season"]: r for r in po.packout_regression(df).collect()}
    for k, s in enumerate(seasons):
        assert got[s]["n"] == 40
        assert got[s]["intercept"] == pytest.approx(beta[2 * k]) and got[s]["slope"] == pytest.approx(beta[2 * k + 1])
        assert got[s]["se_intercept"] == pytest.approx(se[2 * k]) and got[s]["se_slope"] == pytest.approx(se[2 * k + 1])


def test_regression_equals_spark_regr_functions(stored):
    df, _ = stored
    clean = df.filter("storage_days IS NOT NULL AND packout > -1 AND NOT isnan(packout)")
    want = clean.groupBy("season").agg(
        F.regr_slope("packout", "storage_days").alias("b"), F.regr_intercept("packout", "storage_days").alias("a")
    )
    for r in po.packout_regression(df).join(want, "season").collect():
        assert r["slope"] == pytest.approx(r["b"], rel=1e-10) and r["intercept"] == pytest.approx(r["a"], rel=1e-10)


def test_capped_regression_equals_regression_of_capped_batches(spark, rows_of):
    rows = [(2024, d, 0.9 - 0.002 * d + 0.001 * (d % 3)) for d in range(0, 80)]
    rows += [(2025, d, 0.95 - 0.001 * d + 0.002 * (d % 2)) for d in range(0, 41)] + [(2025, 44, None)]
    df = spark.createDataFrame(rows, "season int, storage_days int, packout double")
    a = po.packout_regression(df, cap_season=2025).orderBy("season").collect()
    b = po.packout_regression(po.storage_day_cap(df, 2025)).orderBy("season").collect()
    assert [r["max_days"] for r in a] == [44, 40]
    for p, q in zip(a, b):
        assert tuple(p) == pytest.approx(tuple(q))


def test_trend_line_passes_through_the_means(stored):
    df, _ = stored
    fit = po.packout_regression(df)
    line = po.trend_line(fit).collect()
    by_season = {r["season"]: r for r in fit.collect()}
    for r in line:
        f = by_season[r["season"]]
        assert f["min_days"] <= r["storage_days"] <= f["max_days"] and r["lower"] < r["fit"] < r["upper"]
        assert r["fit"] == pytest.approx(f["intercept"] + f["slope"] * r["storage_days"])
        t = (r["upper"] - r["fit"]) / r["se_fit"]
        assert t == pytest.approx(2.024394, abs=1e-4)  # t quantile for 38 degrees of freedom


def test_slope_ratio(stored):
    df, _ = stored
    fit = {r["season"]: r["slope"] for r in po.packout_regression(df).collect()}
    assert po.slope_ratio(po.packout_regression(df), 2024, 2022).first()["ratio"] == pytest.approx(fit[2024] / fit[2022])


# --- defects ---

def test_sample_qty(tables, bounds, rows_of):
    assessed = quality_data.defect_assessments(tables)
    assert rows_of(dfc.sample_qty_by_batch(assessed)) == [(1, 100), (6, 600), (None, 50)]
    assert rows_of(dfc.sample_qty_by_batch(assessed, bounds)) == [(1, 100), (6, 200), (None, 50)]


def test_batch_defect_proportion(tables, batches, bounds):
    assessed, lines = quality_data.defect_assessments(tables), quality_data.defects(tables)
    samples = dfc.sample_qty_by_batch(assessed)
    kept = {(r["grader_batch_id"], r["defect"]): r["prop"] for r in dfc.batch_defect_proportion(lines, assessed, samples, batches).collect()}
    # The null quantity makes batch 6's russet unknown; the assessment without a batch is gone.
    assert set(kept) == {(1, "Bruise"), (1, "Russet"), (6, "Bruise")}
    assert kept[(1, "Bruise")] == pytest.approx(14 / 100 * 125 / 1000)
    by_input = dfc.batch_defect_proportion(lines, assessed, samples, batches, drop="input")
    assert {(r["grader_batch_id"], r["defect"]) for r in by_input.collect()} == set(kept) | {(6, "Russet")}
    profile = {(r["season"], r["defect"]): r["prop"] for r in dfc.defect_profile(by_input, bounds).collect()}
    assert profile[(2024, "Bruise")] == pytest.approx(14 / 100 * 125 / 1000) and profile[(2025, "Russet")] is None
    with pytest.raises(ValueError):
        dfc.batch_defect_proportion(lines, assessed, samples, batches, drop="none")


def test_top_defects_order_ties_and_other_seasons(spark, rows_of):
    rows = [(2025, "a", 0.1), (2025, "b", 0.3), (2025, "c", 0.1), (2025, "d", None), (2025, "e", 0.05), (2024, "b", 0.9), (2024, "z", 0.99)]
    profile = spark.createDataFrame(rows, "season int, defect string, prop double")
    top = rows_of(dfc.top_defects(profile, 2025, n=3), "season", "defect", "rank")
    assert top == [(2024, "b", 2), (2025, "b", 2), (2025, "c", 3), (2025, "d", 1)]


# --- pests ---

def test_phyto_chain(tables, bounds, rows_of):
    findings = phyto_data.phyto_assessments(tables)
    summary = ph.phyto_lot_summary(findings, phyto_data.mpi_lot_detail(tables))
    quantities = {(r["lot_id"], r["defect"]): (r["defect_qty"], r["sample_qty"]) for r in summary.collect()}
    assert quantities[(100, "Scale")] == (4, 1200)      # two rules, counted twice
    needed = ph.with_requirements(summary, phyto_data.lot_pip_requirements(tables))
    assert rows_of(needed, "lot_id", "mkt_defect_code", "storage_days") == [(100, "SCA", 15), (101, "SCA", 15), (102, "SCA", 20)]
    cheaper = phyto_data.findings_with_requirements(tables, summary)
    assert rows_of(cheaper, *needed.columns) == rows_of(needed)
    lots = phyto_data.mpi_lots(tables)
    full = rows_of(ph.interception_rate(needed, lots))
    assert full == [(2024, 2, 2, 1.0), (2025, 1, 2, 0.5)]
    assert rows_of(ph.interception_rate(needed, lots, bounds)) == full
    assert rows_of(ph.interception_rate(needed, lots, bounds, exclude=["SCA"])) == []


def test_exclusion_keeps_findings_without_a_code(spark, rows_of):
    found = spark.createDataFrame([(2024, 1, None), (2024, 2, "LLT")], "season int, lot_id int, mkt_defect_code string")
    lots = spark.createDataFrame([(2024, 1), (2024, 2)], "season int, lot_id int")
    assert rows_of(ph.interception_rate(found, lots)) == [(2024, 1, 2, 0.5)]


def test_pest_counts_and_order(tables, bounds, rows_of):
    counts = ph.pest_counts(phyto_data.phyto_assessments(tables), phyto_data.lot_ids(tables), bounds)
    # The finding on 21 April 2024 is past the close; the one late on 20 April 2025 is not.
    assert rows_of(counts) == [(2024, "Mealybug", 1), (2024, "Scale", 4), (2025, "Scale", 14)]
    ordered = ph.order_by_season(counts, 2025, "defect", "defect_qty")
    assert rows_of(ordered, "season", "defect", "rank") == [(2024, "Mealybug", None), (2024, "Scale", 1), (2025, "Scale", 1)]


# --- size ---

def test_moments_and_yoy(tables):
    fruit = fruit_data.fruit_measurements(tables, range(2022, 2026), MD)
    rows = {r["season"]: r for r in sz.size_moments(fruit).collect()}
    minor, elong = [50.0, 60.0, 60.0], [60 / 50, 66 / 60, 66 / 60]
    assert rows[2024]["mean_eq"] == pytest.approx(np.mean(minor)) and rows[2024]["sd_eq"] == pytest.approx(np.std(minor, ddof=1))
    assert rows[2024]["covar"] == pytest.approx(np.cov(minor, elong)[0, 1])
    yoy = {r["season"]: r["yoy"] for r in sz.yoy_change(sz.size_moments(fruit), "mean_eq").collect()}
    assert yoy[2024] is None and yoy[2025] == pytest.approx(58 / np.mean(minor) - 1)


def test_density_integrates_to_one(spark):
    moments = spark.createDataFrame([(2024, 56.0, 4.0)], "season int, mean_eq double, sd_eq double")
    curve = sz.density_curve(moments, "eq", 20, 92)
    assert curve.count() == 73
    assert curve.agg(F.sum("density")).first()[0] == pytest.approx(1.0, abs=1e-6)


def test_bands(tables, rows_of):
    shares = sz.size_band_share(fruit_data.fruit_measurements(tables, [2024]))
    assert rows_of(shares) == [(1, "FP", 3, 0.6), (1, "OOS", 1, 0.2), (1, "Tube", 1, 0.2), (2, "Tube", 1, 1.0)]
    assert rows_of(sz.size_band_pivot(shares)) == [(1, 0.6, 0.2, 0.2), (2, 0.0, 1.0, 0.0)]


def test_histogram_keeps_every_value(spark, rows_of):
    df = spark.createDataFrame([(0.0,), (0.24,), (0.25,), (1.0,), (1.3,), (-0.1,), (None,)], "x double")
    got = dict(rows_of(sz.histogram(df, "x", 0.0, 0.25, 4)))
    assert got == {-1: 1, 0: 2, 1: 1, 2: 0, 3: 1, 5: 1}


# --- report ---

def test_season_kpis(tables, deliveries, batches, bounds):
    kpis = season_kpis(deliveries, packing_data.bins_tipped(tables), batches, SITE, MD)
    rows = {r["season"]: r.asDict() for r in kpis.collect()}
    assert set(rows) == {2024, 2025}
    assert rows[2024] == {
        "season": 2024, "first_harvest": dt.date(2024, 2, 15), "last_harvest": dt.date(2024, 4, 21),
        "first_pack": dt.date(2024, 3, 1), "days_packing": 50, "bins": 30, "bins_per_day": 70 / 66,
        "first_pick_share": 66 / 86, "bins_tipped": 4, "packout": 1 - 180 / 1500,
    }
