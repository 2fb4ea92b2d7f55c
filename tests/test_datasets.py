from decimal import Decimal as D

import pytest

from cropline.plans import fruit_data, harvest_data, packing_data, phyto_data, quality_data
from cropline.sources.files import SQL_DIR, run_sql_file
from tests.fixtures import OTHER_SITE, SITE, day


def test_bins_harvested(tables, rows_of):
    rows = rows_of(harvest_data.bins_harvested(tables), "season", "bin_delivery_id", "no_of_bins", "storage_site")
    assert len(rows) == 11
    assert (2024, 1, 10, "Cool store") in rows and (None, 8, 1, "Cool store") in rows


def test_bins_harvested_pick(tables, rows_of):
    rows = rows_of(harvest_data.bins_harvested_pick(tables), "bin_delivery_id", "pick_no")
    assert (2, 2) in rows and (1, 1) in rows


def test_bins_tipped_needs_a_bin(tables, rows_of):
    rows = rows_of(packing_data.bins_tipped(tables))
    assert rows == [
        (1, 2024, day("2024-03-01"), SITE, 3), (2, 2024, day("2024-03-11"), SITE, 1), (6, 2025, day("2025-03-02"), SITE, 2)
    ]


def test_batch_detail_weights(tables):
    rows = {r["grader_batch_id"]: r["reject_kgs"] for r in packing_data.grader_batch_detail(tables).collect()}
    assert 8 not in rows                                   # presize input
    assert rows[1] == D("100") + D("10") + D("15")          # waste + juice + both sample lines
    assert rows[2] == D("55") and rows[3] is None and rows[6] == D("300")


def test_fan_out_per_sample_line(tables, rows_of):
    fan = [r for r in rows_of(packing_data.grader_batch(tables), "grader_batch_id", "reject_kgs") if r[0] == 1]
    assert fan == [(1, D("115.0000")), (1, D("120.0000"))]
    once = [r for r in rows_of(packing_data.grader_batch(tables, aggregate_samples=True), "grader_batch_id", "reject_kgs")]
    assert [r for r in once if r[0] == 1] == [(1, D("125.0000"))] and len(once) == 10


def test_grader_batch_flags_and_growers(tables):
    rows = {r["grader_batch_id"]: r for r in packing_data.grader_batch(tables, aggregate_samples=True).collect()}
    assert rows[9]["batch_closed"] == 0 and rows[10]["batch_closed"] == 1
    assert rows[1]["grower"] == "Farm grower" and rows[1]["bins_tipped"] == 3 and rows[5]["bins_tipped"] is None


def test_site_by_block_differs_from_site_of_batch(tables):
    direct = {r["grader_batch_id"]: r["production_site"] for r in packing_data.grader_batch(tables).collect()}
    by_block = {r["grader_batch_id"]: r["production_site"] for r in packing_data.grader_batch_by_block(tables).collect()}
    assert direct[10] == "S1" and by_block[10] == "S2" and direct[1] == by_block[1] == "S1"


def test_bin_delivery(tables):
    rows = {r["bin_delivery_id"]: r for r in harvest_data.bin_delivery(tables).collect()}
    assert 4 not in rows
    assert (rows[1]["bins_assigned_for_tipping"], rows[1]["bins_in_storage"]) == (2, 8)
    assert (rows[7]["bins_assigned_for_tipping"], rows[7]["bins_in_storage"]) == (0, 5)
    assert (rows[2]["storage_type"], rows[1]["storage_type"]) == ("CA", "RA")
    assert (rows[5]["smart_freshed"], rows[1]["smart_freshed"]) == ("No 1-MCP applied", "1-MCP applied")
    assert rows[6]["management_area"] == "M2" and rows[6]["production_site"] == "S2"


def test_bin_usage(tables, rows_of):
    assert rows_of(harvest_data.bin_usage(tables)) == [(1, 0, 5), (1, 1, 10), (2, 1, None)]


def test_bins_for_grader_batch(tables, rows_of):
    assert rows_of(harvest_data.bins_for_grader_batch(tables)) == [(2024, 1, 1, 2), (2024, 1, 2, 1), (2024, 2, 2, 1), (2025, 6, 5, 2)]


def test_transfers(tables, rows_of):
    assert rows_of(harvest_data.transfers(tables)) == [
        (1, "D1", 1, day("2024-03-01"), "Cool store", SITE),
        (1, "D1", 1, day("2024-03-02"), SITE, OTHER_SITE),
        (1, "D1", None, day("2024-03-01"), "Cool store", SITE),
    ]


def test_defect_datasets(tables, rows_of):
    assert len(rows_of(quality_data.defect_assessments(tables))) == 5
    assert len(rows_of(quality_data.defects(tables))) == 13
    summary = quality_data.defect_assessment_summary(tables)
    rows = rows_of(summary, "grader_batch_id", "defect", "defect_qty", "sample_qty")
    assert (1, "Bruise", 14, 100) in rows and (None, "Bruise", 9, None) in rows and (6, "Russet", 40, 600) in rows


def test_market_rules_are_distinct_and_keep_rules_without_requirement(tables, rows_of):
    assert rows_of(phyto_data.market_pest_rules(tables)) == sorted([
        (1, "SCA", "Free from scale"), (2, "LLT", "Free from all"), (2, "SCA", "Free from all"), (3, "MIT", None),
    ], key=repr)


def test_a_pest_under_two_rules_appears_twice(tables, rows_of):
    ids = [r[0] for r in rows_of(phyto_data.phyto_assessments(tables), "assessment_defect_id")]
    assert sorted(ids) == [8, 8, 9, 10, 10, 11, 11]
    once = [r[0] for r in rows_of(phyto_data.phyto_assessments(tables, dedupe=True), "assessment_defect_id")]
    assert sorted(once) == [8, 9, 10, 11]
    every = [r[0] for r in rows_of(phyto_data.phyto_assessments_all(tables), "assessment_defect_id")]
    assert sorted(every) == [8, 9, 10, 11, 13]


def test_lot_datasets(tables, rows_of):
    sites = rows_of(phyto_data.mpi_lot_sites(tables), "lot_id", "grower", "packing_site")
    assert sites[0] == (100, "Batch grower", SITE) and len(sites) == 4
    assert len(rows_of(phyto_data.mpi_lots(tables))) == 4
    assert "production_site" not in phyto_data.mpi_lot_detail(tables, with_site=False).columns
    requirements = rows_of(phyto_data.lot_pip_requirements(tables), "lot_id", "mkt_defect_code")
    assert requirements == [(100, "SCA"), (101, "LLT"), (101, "SCA"), (102, "ROT"), (102, "SCA")]
    assert rows_of(phyto_data.cartons_by_lot(tables)) == [(2024, 100, 2), (2025, None, 1)]


def test_fruit_window_and_exclusions(tables, rows_of):
    to_close = fruit_data.fruit_measurements(tables, range(2022, 2026), "-04-20")
    assert rows_of(to_close, "season", "batch_id", "size_name") == [
        (2024, 1, "53/2"), (2024, 1, "63/3"), (2024, 1, "99/9"), (2025, 3, "58/5"),
    ]
    whole = fruit_data.fruit_measurements(tables, [2024])
    assert whole.count() == 6 and {r["season"] for r in whole.collect()} == {2024}


SAME_ROWS = {
    "bin_usage.sql": (harvest_data.bin_usage, {}),
    "cartons_by_lot.sql": (phyto_data.cartons_by_lot, {}),
    "grader_batch.sql": (packing_data.grader_batch, {"juice_product": 278}),
    "grader_batch_by_block.sql": (packing_data.grader_batch_by_block, {"juice_product": 278}),
}


@pytest.mark.parametrize("name", SAME_ROWS)
def test_sql_file_gives_the_same_rows(spark, tables, rows_of, name):
    build, args = SAME_ROWS[name]
    assert rows_of(run_sql_file(spark, SQL_DIR / name, tables, **args)) == rows_of(build(tables))


def test_sql_file_with_parameters(spark, tables, rows_of):
    weights = run_sql_file(spark, SQL_DIR / "sample_weight.sql", tables, juice_product=278)
    juice = {r["grader_batch_id"]: r["juice_kgs"] for r in packing_data.juice_kgs(tables).collect()}
    sample = {r["grader_batch_id"]: r["sample_kgs"] for r in packing_data.sample_kgs(tables).collect()}
    for r in weights.collect():
        assert r["juice_kgs"] == juice.get(r["grader_batch_id"], 0) and r["sample_kgs"] == sample.get(r["grader_batch_id"], 0)
    bins = run_sql_file(spark, SQL_DIR / "bins_in_season.sql", tables, season="2024")
    assert bins.columns == ["Grader batch", "Bin delivery", "Bins tipped"]
    assert rows_of(bins) == [(1, 1, 2), (1, 2, 1), (2, 2, 1)]
