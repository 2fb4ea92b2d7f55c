import pytest

from cropline.plans.full_report import ReportSettings, displays, report_frames
from cropline.schema import TABLES, schema_of
from cropline.sources.sinks import write_chart_data
from cropline.sources.tables import land, land_tables
from tests.fixtures import ROWS, SITE, batch, delivery


@pytest.fixture(scope="module")
def archive(spark):
    """A second database with an older season, in which the season's key differs."""
    rows = {
        **ROWS,
        "sw_SeasonT": [(9, "2023")],
        "ma_Bin_DeliveryT": [delivery(1, 9, "2023-02-20", 11), delivery(2, 9, "2023-05-01", 5)],
        "ma_Grader_BatchT": [
            batch(1, 9, "2023-02-20", "2023-03-02", "100", "10"), batch(2, 9, "2023-02-21", "2023-03-13", "100", "30"),
        ],
        "ma_Pallet_DetailT": [],
    }
    return {name: spark.createDataFrame(rows.get(name, []), schema_of(name)) for name in TABLES}


@pytest.fixture(scope="module")
def settings():
    return ReportSettings(SITE, ["Cool store"], 2025, 2024, "-04-20", archive_seasons=[2023], excluded_pests=["LLT"])


def test_whole_report(spark, tables, archive, settings, tmp_path, rows_of):
    frames = report_frames(land_tables(tables, str(tmp_path / "landed")), settings, str(tmp_path / "work"), archive)
    write_chart_data(frames, str(tmp_path / "report"))
    write_chart_data(frames, str(tmp_path / "shown"), displays=displays(settings))
    shown = spark.read.parquet(str(tmp_path / "shown" / "packout_to_date"))
    assert shown.columns == ["Season", "Packout"] and shown.filter("Season = 2024").first()["Packout"] == "88.0%"
    sites = spark.read.parquet(str(tmp_path / "shown" / "bins_harvested_by_site"))
    assert sites.columns == ["Season", "Cool store", "Other sites", "No site", "Total"]
    assert rows_of(sites, "Season", "Total") == [(2024, "30"), (2025, "85")]
    back = {name: spark.read.parquet(str(tmp_path / "report" / name)) for name in frames}
    assert rows_of(back["harvest_curve"], "season", "cum_bins") == [
        (2023, 11), (2024, 10), (2024, 30), (2025, 30), (2025, 80), (2025, 85),
    ]
    model = {r["season"]: r for r in back["packout_model"].collect()}
    assert set(model) == {2023, 2024, 2025} and model[2023]["slope"] == pytest.approx((0.7 - 0.9) / 10)
    assert rows_of(back["interception_rate"]) == [(2024, 2, 2, 1.0), (2025, 1, 2, 0.5)]
    assert {r["season"] for r in back["season_kpis"].collect()} == {2024, 2025}
    assert all(df.count() for df in back.values())


def test_landed_tables_hold_the_same_rows_and_prune(spark, tables, tmp_path, rows_of):
    landed = land_tables(tables, str(tmp_path / "landed"))
    for name in TABLES:
        assert rows_of(landed[name]) == rows_of(tables[name]) and landed[name].columns == tables[name].columns
    one = landed["ma_Grader_BatchT"].filter("SeasonID = 2")
    assert "PartitionFilters: [isnotnull(SeasonID" in one._jdf.queryExecution().executedPlan().toString()
    joined = landed["ma_Grader_BatchT"].join(landed["sw_SeasonT"], "SeasonID")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_land_keeps_rows(tables, tmp_path, rows_of):
    assert rows_of(land(tables["ma_BinT"], str(tmp_path / "bins"))) == rows_of(tables["ma_BinT"])
