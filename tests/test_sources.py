import pytest
from pyspark.sql import functions as F

from cropline.operators.bounds import season_to_date
from cropline.operators.size import size_moments
from cropline.plans import fruit_data, packing_data
from cropline.schema import TABLES, schema_of
from cropline.sources import files, jdbc, sinks
from cropline.sources.tables import conform, read_tables
from tests.fixtures import at, day


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("source"))
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}")
    return read_tables(spark, root)


@pytest.fixture(scope="module", autouse=True)
def whole_plans(spark):
    """Do not abbreviate the filters shown in a plan."""
    spark.conf.set("spark.sql.maxMetadataStringLength", 10000)
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_tables_read_back(stored, tables, rows_of):
    assert set(stored) == set(TABLES)
    for name in TABLES:
        assert stored[name].schema == schema_of(name)
        assert rows_of(stored[name]) == rows_of(tables[name])


def test_fruit_filter_and_columns_reach_the_scan(spark, stored):
    plan = plan_of(size_moments(fruit_data.fruit_measurements(stored, [2024, 2025], "-04-20")))
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    for part in ("GreaterThan(START_TIME,2024-01-01T00:00", "Not(In(SIZER_GRADE_NAME", "GreaterThan(MINOR,30.0)"):
        assert part in scan
    assert "GROWER_NAME" not in scan and "BATCH_ID" not in scan


def test_overall_range_of_the_bounds_reaches_the_batch_scan(spark, stored):
    frame = spark.createDataFrame(
        [(2024, day("2024-02-15"), day("2024-03-01"), day("2024-04-20"))],
        "season int, first_harvest date, first_pack date, close date",
    )
    rows = season_to_date(packing_data.grader_batch_dates(stored), frame, "pack_date", "first_pack", "lt")
    scan = next(line for line in plan_of(rows).splitlines() if "FileScan parquet" in line and "PackDate" in line)
    filters = scan.split("DataFilters:")[1].split("Format:")[0]  # worked out before the scan and pushed with their values
    assert ">= Subquery" in filters and "<= Subquery" in filters


def test_csv_round_trip(spark, tmp_path, rows_of):
    df = spark.createDataFrame(
        [(2022, day("2022-02-15"), 54, 54, day("2024-02-15"))],
        "Season int, HarvestDate date, NoOfBins bigint, cumBins bigint, PlotDate date",
    )
    sinks.write_csv(df, str(tmp_path / "curve"))
    assert rows_of(files.read_csv(spark, str(tmp_path / "curve"), files.HARVEST_CURVE)) == rows_of(df)


def test_malformed_csv_fails(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("Season,HarvestDate,NoOfBins,cumBins,PlotDate\n2022,not a date,1,1,2024-02-15\n")
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "bad.csv"), files.HARVEST_CURVE).collect()


def test_report_table_sink(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "season int, site string")
    sinks.write_report_table(df, str(tmp_path / "t"), order_by=["season"], rename={"site": "Packing site"}, fmt="csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "t"))
    assert back.columns == ["season", "Packing site"] and back.count() == 2
    sinks.write_chart_data({"one": df, "two": df}, str(tmp_path / "charts"))
    assert spark.read.parquet(str(tmp_path / "charts" / "two")).count() == 2


def test_dataset_sink_prunes_seasons(spark, tmp_path):
    df = spark.createDataFrame([(2024, 1), (2025, 2)], "season int, x int")
    sinks.write_dataset(df, str(tmp_path / "d"))
    one = spark.read.parquet(str(tmp_path / "d")).filter(F.col("season") == 2025)
    assert "PartitionFilters: [isnotnull(season" in plan_of(one) and one.first()["x"] == 2


def test_conform_gives_declared_types(spark):
    raw = spark.createDataFrame(
        [(1, 11, 12, at("2024-03-01T00:00:00"), "x")],
        "TransferID int, FromStorageSiteCompanyID int, ToStorageSiteCompanyID int, TransferDate timestamp_ntz, Extra string",
    )
    df = conform(raw, "ma_TransferT")
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schema_of("ma_TransferT")]
    assert df.first()["TransferDate"] == day("2024-03-01")


def test_jdbc_options():
    db = jdbc.JdbcDatabase.from_env("PACK", {"PACK_URL": "jdbc:x://h/db", "PACK_USER": "u", "PACK_PASSWORD": "p"})
    assert db.password == "p" and "password" not in repr(db)
    split = jdbc.Split("GraderBatchID", 0, 1000, 8)
    opts = jdbc.read_options(db, table="ma_Grader_BatchT", split=split)
    assert opts["dbtable"] == "ma_Grader_BatchT" and opts["numPartitions"] == "8" and opts["user"] == "u"
    assert jdbc.read_options(db, query="SELECT 1")["query"] == "SELECT 1"
    assert jdbc.read_options(db, query="SELECT 1", split=split)["dbtable"] == "(SELECT 1) q"
    with pytest.raises(ValueError):
        jdbc.read_options(db)


def test_warehouse_catalog_settings(spark):
    db = jdbc.JdbcDatabase("jdbc:x://h/db", driver="a.b.Driver")
    settings = jdbc.catalog_settings("lake", db)
    assert settings["spark.sql.catalog.lake"] == jdbc.CATALOG_CLASS
    assert settings["spark.sql.catalog.lake.pushDownAggregate"] == "true"
    jdbc.attach_warehouse(spark, "lake", db)
    assert spark.conf.get("spark.sql.catalog.lake.url") == "jdbc:x://h/db"
