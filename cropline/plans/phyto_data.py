"""Phytosanitary datasets: pest findings, market rules, export lots and their requirements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropline.functions.scalars import days_between
from cropline.operators.relational import pick
from cropline.plans import dimensions as dim
from cropline.plans.dimensions import Tables
from cropline.plans.quality_data import assessments, defect_lines, defect_names

# Market codes and the pest assessment template of the source database.
MARKETS = ("CHN", "TWN")
PEST_TEMPLATE = 10


def market_pest_rules(t: Tables, markets: Sequence[str] = MARKETS) -> DataFrame:
    """Distinct (requirement, pest code, declaration) with a zero threshold in one of the markets.

    The zero-threshold filter makes market requirement to pest rule an inner join; a pest rule
    without a requirement row stays, with a null declaration.
    """
    market = pick(t["pip_Market_RequirementT"].filter(F.col("PIPMarketCode").isin(list(markets))), pip_req_id="PIPReqID")
    rules = t["pip_Requirement_PestT"].join(t["pip_RequirementT"], "PIPReqID", "left").filter("ThresholdQty = 0")
    rules = pick(rules, pip_req_id="PIPReqID", mkt_defect_code="MktDefectCode", declaration="DeclarationDesc")
    return market.join(rules, "pip_req_id").select("pip_req_id", "mkt_defect_code", "declaration").distinct()


def _findings(t: Tables, template: int) -> DataFrame:
    coded = defect_names(t).filter(F.col("mkt_defect_code").isNotNull())
    return (
        defect_lines(t)
        .join(coded, "defect_id")
        .join(assessments(t, [template]), "assessment_id")
        .join(dim.seasons(t), "season_id")
    )


_FINDING_COLUMNS = (
    "assessment_defect_id", "assessment_id", "season", "grader_batch_id", "lot_id", "defect", "defect_qty",
    "sample_qty", "mkt_defect_code",
)


def phyto_assessments(
    t: Tables, markets: Sequence[str] = MARKETS, template: int = PEST_TEMPLATE, dedupe: bool = False
) -> DataFrame:
    """Pest findings that some market rule covers.

    A pest under several rules appears once per rule, as its published totals were computed;
    ``dedupe=True`` keeps each finding once.
    """
    rules = market_pest_rules(t, markets)
    findings = _findings(t, template)
    if dedupe:
        covered = findings.join(rules, "mkt_defect_code", "left_semi")
    else:
        covered = findings.join(rules.select("mkt_defect_code", "pip_req_id"), "mkt_defect_code")
    return covered.select(*_FINDING_COLUMNS, "assessed_at")


def phyto_assessments_all(t: Tables, template: int = PEST_TEMPLATE) -> DataFrame:
    """Pest findings with a market code, whatever the rules say."""
    return _findings(t, template).select(*_FINDING_COLUMNS)


def _lots(t: Tables) -> DataFrame:
    lots = pick(
        t["ma_Grader_Batch_MPI_LotT"], lot_id="GraderBatchMPILotID", grader_batch_id="GraderBatchID",
        lot_no="MPILotNo",
    )
    batches = pick(
        t["ma_Grader_BatchT"], grader_batch_id="GraderBatchID", season_id="SeasonID", farm_id="FarmID",
        subdivision_id="SubdivisionID", packer_id="PackingCompanyID", batch_grower_id="GrowerCompanyID",
        pack_date="PackDate", harvest_date="HarvestDate",
    )
    return lots.join(batches, "grader_batch_id").join(dim.seasons(t), "season_id")


def mpi_lot_detail(t: Tables, with_site: bool = True) -> DataFrame:
    """Lots with farm, production site and dates. ``with_site=False`` is the older form without the site."""
    lots = _lots(t).join(dim.farms(t), "farm_id")
    if with_site:
        lots = lots.join(dim.subdivisions(t), "subdivision_id")
    return lots.select(
        "lot_id", "grader_batch_id", "lot_no", F.col("farm_code").alias("rpin"), F.col("farm_name").alias("orchard"),
        *(["production_site"] if with_site else []), "pack_date", "harvest_date",
    )


def mpi_lot_sites(t: Tables) -> DataFrame:
    """Lots with grower and packer names. The grower is the batch's, not the farm's."""
    return (
        _lots(t)
        .join(dim.farms(t), "farm_id")
        .join(dim.subdivisions(t), "subdivision_id")
        .join(dim.companies(t, "batch_grower_id", "grower"), "batch_grower_id")
        .join(dim.companies(t, "packer_id", "packing_site"), "packer_id")
        .select(
            "lot_id", "grader_batch_id", "grower", F.col("farm_code").alias("rpin"),
            F.col("farm_name").alias("orchard"), "production_site", "packing_site",
        )
    )


def lot_ids(t: Tables) -> DataFrame:
    """The lot table's lots, as often as it lists them."""
    return pick(t["ma_Grader_Batch_MPI_LotT"], lot_id="GraderBatchMPILotID")


def mpi_lots(t: Tables) -> DataFrame:
    return _lots(t).select("lot_id", "grader_batch_id", "pack_date", "season")


_REQUIREMENT_COLUMNS = (
    "lot_requirement_id", "lot_id", "pip_req_id", "declaration", "pip_group", "mkt_defect_code", "percent_limit",
    "threshold_qty",
)


def _rules_of(t: Tables, lots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join requirement and pest columns one table at a time, so that each is broadcast by its own size."""
    requirements = pick(
        t["pip_RequirementT"], pip_req_id="PIPReqID", declaration="DeclarationDesc", pip_group="PIPGroup"
    )
    pests = pick(
        t["pip_Requirement_PestT"], pip_req_id="PIPReqID", mkt_defect_code="MktDefectCode",
        percent_limit="PercentLimit", threshold_qty="ThresholdQty",
    )
    return lots.join(requirements, "pip_req_id").join(pests, list(keys))


def _lot_requirements(t: Tables) -> DataFrame:
    return pick(
        t["ma_Grader_Batch_MPI_Lot_PIP_RequirementT"], lot_requirement_id="GraderBatchMPILotPIPRequirementID",
        lot_id="GraderBatchMPILotID", pip_req_id="PIPReqID",
    )


def lot_pip_requirements(t: Tables) -> DataFrame:
    """One row per lot requirement and pest."""
    return _rules_of(t, _lot_requirements(t), ["pip_req_id"]).select(*_REQUIREMENT_COLUMNS)


def findings_with_requirements(t: Tables, summary: DataFrame) -> DataFrame:
    """The rows of ``phyto.with_requirements(summary, lot_pip_requirements(t))`` by a cheaper route.

    The summary meets the lot requirements before these are multiplied by their pests, so the
    multiplied table is never shuffled.
    """
    lots = summary.join(_lot_requirements(t), "lot_id")
    rows = _rules_of(t, lots, ["pip_req_id", "mkt_defect_code"])
    return rows.select(
        *summary.columns, *[c for c in _REQUIREMENT_COLUMNS if c not in summary.columns]
    ).withColumn("storage_days", days_between("harvest_date", "pack_date"))


def cartons_by_lot(t: Tables) -> DataFrame:
    return (
        pick(
            t["ma_CartonT"].filter("CartonExistsFlag"), season_id="SeasonID", lot_id="GraderBatchMPILotID",
            carton_no="CartonNo",
        )
        .join(dim.seasons(t), "season_id")
        .groupBy("season", "lot_id")
        .agg(F.count("carton_no").alias("cartons"))
    )
