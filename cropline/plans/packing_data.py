"""Packing-side datasets: grader batches with their weights and tipped bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropline.functions.scalars import or_zero
from cropline.operators.relational import pick
from cropline.plans import dimensions as dim
from cropline.plans.dimensions import Tables
from cropline.schema import KG

# Fixed value: product id of juice fruit in the source database.
JUICE_PRODUCT = 278


def _batches(t: Tables) -> DataFrame:
    return pick(
        t["ma_Grader_BatchT"], grader_batch_id="GraderBatchID", grader_batch="GraderBatchNo", season_id="SeasonID",
        farm_id="FarmID", block_id="BlockID", subdivision_id="SubdivisionID", maturity_id="MaturityID",
        pick_no_id="PickNoID", storage_type_id="StorageTypeID", packer_id="PackingCompanyID",
        harvest_date="HarvestDate", pack_date="PackDate", input_kgs="InputKgs", waste_kgs="WasteOtherKgs",
        closed_at="ClosedDateTime", presize_input="PresizeInputFlag",
    )


def juice_kgs(t: Tables, product_id: int = JUICE_PRODUCT) -> DataFrame:
    """Juice weight by the batch that put it out."""
    return (
        pick(
            t["ma_Bin_DeliveryT"].filter(F.col("PresizeProductID") == product_id),
            grader_batch_id="PresizeOutputFromGraderBatchID", kgs="TotalWeight",
        )
        .groupBy("grader_batch_id")
        .agg(F.sum("kgs").cast(KG).alias("juice_kgs"))
    )


def sample_lines(t: Tables) -> DataFrame:
    """Weight of each pallet line of a sample product."""
    lines = pick(t["ma_Pallet_DetailT"], grader_batch_id="GraderBatchID", product_id="ProductID", units="NoOfUnits")
    products = pick(t["sw_ProductT"].filter("SampleFlag"), product_id="ProductID", weight="NetFruitWeight")
    return lines.join(products, "product_id").select(
        "grader_batch_id", (F.col("units") * F.col("weight")).cast(KG).alias("sample_kgs")
    )


def sample_kgs(t: Tables) -> DataFrame:
    """Sample weight by batch."""
    return sample_lines(t).groupBy("grader_batch_id").agg(F.sum("sample_kgs").cast(KG).alias("sample_kgs"))


def tipped_per_batch(t: Tables) -> DataFrame:
    return (
        pick(t["ma_BinT"].filter(F.col("GraderBatchID").isNotNull()), grader_batch_id="GraderBatchID", bin_id="BinID")
        .groupBy("grader_batch_id")
        .agg(F.count("bin_id").alias("bins_tipped"))
    )


def _with_season_and_site(t: Tables, batches: DataFrame) -> DataFrame:
    """Joined before the weights, so that a filter on season or packing site cuts the batches before they
    are shuffled."""
    return batches.join(dim.seasons(t), "season_id").join(dim.companies(t, "packer_id", "pack_site"), "packer_id")


def _reject():
    return (F.col("waste_kgs") + or_zero("juice_kgs") + or_zero("sample_kgs")).cast(KG).alias("reject_kgs")


def bins_tipped(t: Tables) -> DataFrame:
    """Bins tipped by batch; batches without a bin do not appear."""
    return (
        _batches(t)
        .join(tipped_per_batch(t), "grader_batch_id")
        .join(dim.companies(t, "packer_id", "packing_site"), "packer_id")
        .join(dim.seasons(t), "season_id")
        .select(
            "grader_batch_id", "season", "pack_date", "packing_site", F.col("bins_tipped").alias("no_of_bins_tipped")
        )
    )


def grader_batch_detail(t: Tables, juice_product: int = JUICE_PRODUCT) -> DataFrame:
    """Non-presize batches with all their dimensions, input and reject weight: one row per batch."""
    return (
        _with_season_and_site(t, _batches(t).filter(~F.col("presize_input")))
        .join(juice_kgs(t, juice_product), "grader_batch_id", "left")
        .join(sample_kgs(t), "grader_batch_id", "left")
        .join(dim.farms(t), "farm_id")
        .join(dim.subdivisions(t), "subdivision_id")
        .join(dim.maturities(t), "maturity_id")
        .join(dim.storage_types(t), "storage_type_id")
        .join(dim.picks(t), "pick_no_id")
        .select(
            "grader_batch_id", "season", "pack_date", "harvest_date", "farm_code", "farm_name", "production_site",
            "pack_site", "maturity_code", "storage_type", "pick_no", "input_kgs", _reject(),
        )
    )


def _with_sample_lines(batches: DataFrame, lines: DataFrame, ids: DataFrame) -> DataFrame:
    """``batches`` left-joined to their sample lines, as one inner join.

    Batches without a line get an empty one first, found on the keys alone. At run time Spark can split a batch with
    very many lines in an inner join, but not when the lines are the optional side of an outer join.
    """
    sampled = lines.select("grader_batch_id").distinct()
    unsampled = ids.distinct().join(sampled, "grader_batch_id", "left_anti")
    return batches.join(lines.unionByName(unsampled, allowMissingColumns=True), "grader_batch_id")


def _grader_batch(t: Tables, batches: DataFrame, aggregate_samples: bool, juice_product: int) -> DataFrame:
    batches = (
        _with_season_and_site(t, batches)
        .join(juice_kgs(t, juice_product), "grader_batch_id", "left")
        .join(tipped_per_batch(t), "grader_batch_id", "left")
    )
    if aggregate_samples:
        batches = batches.join(sample_kgs(t), "grader_batch_id", "left")
    else:
        ids = pick(t["ma_Grader_BatchT"], grader_batch_id="GraderBatchID")
        batches = _with_sample_lines(batches, sample_lines(t), ids)
    return (
        batches.join(dim.farms(t), "farm_id")
        .join(dim.subdivisions(t), "subdivision_id")
        .join(dim.maturities(t), "maturity_id")
        .join(dim.picks(t), "pick_no_id")
        .join(dim.companies(t, "farm_grower_id", "grower"), "farm_grower_id")
        .select(
            "grader_batch_id", "grader_batch", "season", "grower", F.col("farm_code").alias("rpin"),
            F.col("farm_name").alias("orchard"), "production_site", "harvest_date", "pack_date", "pack_site",
            "bins_tipped", "input_kgs", _reject(), F.col("closed_at").isNotNull().cast("int").alias("batch_closed"),
        )
    )


def grader_batch(t: Tables, aggregate_samples: bool = False, juice_product: int = JUICE_PRODUCT) -> DataFrame:
    """All batches with grower, tipped bins and a closed flag.

    A batch with several sample pallet lines appears once per line, as its published results were
    computed; ``aggregate_samples=True`` gives one row per batch.
    """
    return _grader_batch(t, _batches(t), aggregate_samples, juice_product)


def grader_batch_by_block(t: Tables, aggregate_samples: bool = False, juice_product: int = JUICE_PRODUCT) -> DataFrame:
    """``grader_batch`` for databases in which a batch reaches its production site through its block."""
    batches = _batches(t).drop("subdivision_id").join(dim.blocks(t), "block_id")
    return _grader_batch(t, batches, aggregate_samples, juice_product)


def grader_batch_dates(t: Tables) -> DataFrame:
    return (
        _batches(t)
        .join(dim.seasons(t), "season_id")
        .select("season", "grader_batch_id", "harvest_date", "pack_date")
    )
