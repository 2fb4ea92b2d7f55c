"""Harvest-side datasets: deliveries, bins, bin usage and transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropline.functions.scalars import or_zero
from cropline.operators.relational import pick
from cropline.plans import dimensions as dim
from cropline.plans.dimensions import Tables

# Storage type codes of the source database.
CONTROLLED_ATMOSPHERE = 4
NO_1_MCP = 6


def _harvested(t: Tables) -> DataFrame:
    deliveries = pick(
        t["ma_Bin_DeliveryT"], bin_delivery_id="BinDeliveryID", season_id="SeasonID", pick_no_id="PickNoID",
        site_id="FirstStorageSiteCompanyID", harvest_date="HarvestDate", no_of_bins="NoOfBins",
        presize_flag="PresizeFlag",
    )
    return deliveries.join(dim.companies(t, "site_id", "storage_site"), "site_id").join(dim.seasons(t), "season_id")


_HARVEST_COLUMNS = ("season", "bin_delivery_id", "harvest_date", "no_of_bins", "presize_flag", "storage_site")


def bins_harvested(t: Tables) -> DataFrame:
    """One row per delivery with its season and first storage site."""
    return _harvested(t).select(*_HARVEST_COLUMNS)


def bins_harvested_pick(t: Tables) -> DataFrame:
    """``bins_harvested`` plus the pick number."""
    return _harvested(t).join(dim.picks(t, "PickNo"), "pick_no_id").select(*_HARVEST_COLUMNS, "pick_no")


def bin_delivery(t: Tables) -> DataFrame:
    """Non-presize deliveries with bins received, tipped and still in storage."""
    deliveries = pick(
        t["ma_Bin_DeliveryT"].filter(~F.col("PresizeFlag")),
        bin_delivery_id="BinDeliveryID", bin_delivery_no="BinDeliveryNo", season_id="SeasonID", farm_id="FarmID",
        block_id="BlockID", maturity_id="MaturityID", pick_no_id="PickNoID", storage_type_id="StorageTypeID",
        site_id="FirstStorageSiteCompanyID", harvest_date="HarvestDate", bins_received="NoOfBins",
    )
    tipped = (
        pick(t["ma_BinT"].filter(F.col("GraderBatchID").isNotNull()), bin_delivery_id="BinDeliveryID", bin_id="BinID")
        .groupBy("bin_delivery_id")
        .agg(F.count("bin_id").alias("tipped"))
    )
    tipped_bins = or_zero("tipped")
    return (
        deliveries.join(tipped, "bin_delivery_id", "left")
        .join(dim.seasons(t), "season_id")
        .join(dim.farms(t), "farm_id")
        .join(dim.blocks(t), "block_id")
        .join(dim.subdivisions(t), "subdivision_id")
        .join(dim.maturities(t), "maturity_id")
        .join(dim.picks(t), "pick_no_id")
        .join(dim.companies(t, "site_id", "storage_site"), "site_id")
        .join(dim.companies(t, "farm_grower_id", "grower"), "farm_grower_id")
        .select(
            "season", "bin_delivery_id", "bin_delivery_no", F.col("farm_code").alias("rpin"),
            F.col("farm_name").alias("orchard"), "grower", "production_site",
            F.col("block_code").alias("management_area"), "harvest_date", "bins_received",
            tipped_bins.alias("bins_assigned_for_tipping"),
            (F.col("bins_received") - tipped_bins).alias("bins_in_storage"),
            F.col("maturity_code").alias("submission_profile"), "pick_no", "storage_site",
            F.when(F.col("storage_type_id") == CONTROLLED_ATMOSPHERE, "CA").otherwise("RA").alias("storage_type"),
            F.when(F.col("storage_type_id") == NO_1_MCP, "No 1-MCP applied").otherwise("1-MCP applied")
            .alias("smart_freshed"),
        )
    )


def bin_usage(t: Tables) -> DataFrame:
    """Bins used per delivery, split by whether the batch they went to is closed."""
    usage = pick(
        t["ma_Bin_UsageT"].filter(F.col("GraderBatchID").isNotNull()),
        bin_delivery_id="BinDeliveryID", grader_batch_id="GraderBatchID", qty="BinQty",
    )
    closed = t["ma_Grader_BatchT"].select(
        F.col("GraderBatchID").alias("grader_batch_id"),
        F.col("ClosedDateTime").isNotNull().cast("int").alias("bins_tipped"),
    )
    return (
        usage.join(closed, "grader_batch_id")
        .groupBy("bin_delivery_id", "bins_tipped")
        .agg(F.sum("qty").alias("bin_qty"))
    )


def bins_for_grader_batch(t: Tables) -> DataFrame:
    """Tipped bins by season, batch and delivery, sorted by season.

    Counted before the join, so that one very large batch is already reduced when it is shuffled.
    The further sort keys let the sort split a season over several tasks.
    """
    counted = (
        pick(
            t["ma_BinT"].filter(F.col("GraderBatchID").isNotNull()),
            grader_batch_id="GraderBatchID", bin_delivery_id="BinDeliveryID", bin_id="BinID",
        )
        .groupBy("grader_batch_id", "bin_delivery_id")
        .agg(F.count("bin_id").alias("n"))
    )
    batches = pick(t["ma_Grader_BatchT"], grader_batch_id="GraderBatchID", season_id="SeasonID")
    return (
        counted.join(batches, "grader_batch_id")
        .join(dim.seasons(t), "season_id")
        .groupBy("season", "grader_batch_id", "bin_delivery_id")
        .agg(F.sum("n").alias("bins_tipped"))
        .orderBy("season", "grader_batch_id", "bin_delivery_id")
    )


def transfers(t: Tables) -> DataFrame:
    """Every bin movement with the site it left and the site it went to."""
    bins = pick(t["ma_BinT"], bin_id="BinID", bin_delivery_id="BinDeliveryID", grader_batch_id="GraderBatchID")
    moves = pick(t["ma_Transfer_BinT"], transfer_id="TransferID", bin_id="BinID")
    headers = pick(
        t["ma_TransferT"], transfer_id="TransferID", transfer_date="TransferDate",
        from_id="FromStorageSiteCompanyID", to_id="ToStorageSiteCompanyID",
    )
    deliveries = pick(t["ma_Bin_DeliveryT"], bin_delivery_id="BinDeliveryID", bin_delivery_no="BinDeliveryNo")
    return (
        bins.join(moves, "bin_id")
        .join(headers, "transfer_id")
        .join(deliveries, "bin_delivery_id")
        .join(dim.companies(t, "from_id", "from_storage_site"), "from_id")
        .join(dim.companies(t, "to_id", "to_storage_site"), "to_id")
        .select(
            "bin_delivery_id", "bin_delivery_no", "grader_batch_id", "transfer_date", "from_storage_site",
            "to_storage_site",
        )
    )
