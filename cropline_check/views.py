"""The source tables, derived from the TPC-H-like check tables.

Each source table is a projection of one check table. The expressions are valid in Spark SQL and in
DuckDB, so both engines start from the same rows; everything after that is written separately.
Nulls, zero weights, several lines per batch and rules that overlap are put in on purpose, because
the check tables have none.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

CURRENT, PRIOR = 2001, 2000
SEASONS = tuple(range(1995, 2002))
MONTH_DAY = "-04-20"
SITE = "NATION_3"
SITES = tuple(f"NATION_{i}" for i in range(1, 6))
JUICE = 278
EXCLUDED = ("PROMO", "LARGE")


@dataclass(frozen=True)
class View:
    source: str
    columns: tuple[str, ...]
    where: str | None = None
    distinct: bool = False

    def frame(self, df: DataFrame) -> DataFrame:
        if self.where:
            df = df.filter(self.where)
        df = df.selectExpr(*self.columns)
        return df.distinct() if self.distinct else df

    def sql(self) -> str:
        where = f" WHERE {self.where}" if self.where else ""
        return f"SELECT {'DISTINCT ' if self.distinct else ''}{', '.join(self.columns)} FROM {self.source}{where}"


_SEASON = "CAST(year(o_orderdate) AS BIGINT) AS SeasonID"
_MONTH = "CAST(month(o_orderdate) AS BIGINT)"
_SITE = "CAST(substr(o_orderpriority, 1, 1) AS BIGINT)"
_MATURITY = "CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS BIGINT) AS MaturityID"
_PICK = (
    "CAST(CASE WHEN month(o_orderdate) <= 2 THEN 1 WHEN month(o_orderdate) <= 4 THEN 2 ELSE 3 END AS BIGINT)"
    " AS PickNoID"
)
_DATE = "CAST(o_orderdate AS DATE)"
_PRICE = "CAST(o_totalprice AS DECIMAL(18,2))"
_LINE = "l_orderkey * 10 + l_linenumber"
# Lines repeat (order, line number); with part of the part key the bin id is nearly unique.
_BIN = f"({_LINE}) * 1000 + l_partkey % 1000 AS BinID"
# Bins of two neighbouring deliveries go to two neighbouring batches; a third is not tipped yet.
_BATCH_OF_BIN = (
    "CASE WHEN l_returnflag <> 'N' THEN l_orderkey - l_orderkey % 2 + l_linenumber % 2 END AS GraderBatchID"
)

VIEWS: dict[str, View] = {
    "ma_Bin_DeliveryT": View("orders", (
        "o_orderkey AS BinDeliveryID", "concat('D', CAST(o_orderkey AS STRING)) AS BinDeliveryNo", _SEASON,
        "o_custkey AS FarmID", "o_custkey AS BlockID", _MATURITY, _PICK, f"{_MONTH} AS StorageTypeID",
        f"{_SITE} AS FirstStorageSiteCompanyID", f"{_DATE} AS HarvestDate",
        "CAST(floor(o_totalprice / 5000) AS BIGINT) AS NoOfBins", "o_orderstatus = 'F' AS PresizeFlag",
        f"CAST(CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_totalprice < 250000 THEN {JUICE} ELSE 279 END END"
        " AS BIGINT) AS PresizeProductID",
        "CASE WHEN o_orderstatus = 'F' THEN o_orderkey - o_orderkey % 4 + 1 END AS PresizeOutputFromGraderBatchID",
        "CAST(o_totalprice / 50 AS DECIMAL(18,4)) AS TotalWeight",
    )),
    "ma_BinT": View("lineitem", (_BIN, "l_orderkey AS BinDeliveryID", _BATCH_OF_BIN)),
    "ma_Bin_UsageT": View("lineitem", (
        "l_orderkey AS BinDeliveryID", _BATCH_OF_BIN, "CAST(l_quantity AS BIGINT) AS BinQty",
    )),
    "ma_Grader_BatchT": View("orders", (
        "o_orderkey AS GraderBatchID", "concat('B', CAST(o_orderkey AS STRING)) AS GraderBatchNo", _SEASON,
        "o_custkey AS FarmID", "o_custkey AS BlockID", f"{_MONTH} AS SubdivisionID", _MATURITY, _PICK,
        f"{_MONTH} AS StorageTypeID", f"{_SITE} AS PackingCompanyID", f"{_MONTH} + 5 AS GrowerCompanyID",
        f"{_DATE} AS HarvestDate", f"{_DATE} + CAST(floor(o_totalprice / 5000) AS INT) AS PackDate",
        f"CASE WHEN o_totalprice > 498000 THEN NULL WHEN o_totalprice < 4000 THEN 0"
        f" ELSE CAST({_PRICE} AS DECIMAL(18,4)) END AS InputKgs",
        f"CASE WHEN day(o_orderdate) = 31 THEN NULL WHEN o_totalprice < 3000 THEN 0"
        f" ELSE CAST({_PRICE} * CAST(5 + floor(o_totalprice / 25000) AS DECIMAL(4,0)) * 0.01 AS DECIMAL(18,4)) END"
        " AS WasteOtherKgs",
        "CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS ClosedDateTime",
        "o_orderstatus = 'F' AND o_totalprice >= 400000 AS PresizeInputFlag",
    )),
    "ma_Pallet_DetailT": View("lineitem", (
        "l_orderkey AS GraderBatchID", "l_partkey AS ProductID", "CAST(l_quantity AS INT) AS NoOfUnits",
    )),
    "ma_Grader_Batch_MPI_LotT": View("orders", (
        "o_orderkey AS GraderBatchMPILotID", "o_orderkey - o_orderkey % 2 AS GraderBatchID",
        "concat('L', CAST(o_orderkey AS STRING)) AS MPILotNo",
    )),
    "ma_Grader_Batch_MPI_Lot_PIP_RequirementT": View("lineitem", (
        f"{_LINE} AS GraderBatchMPILotPIPRequirementID", "l_orderkey AS GraderBatchMPILotID",
        "CAST(l_linenumber AS BIGINT) AS PIPReqID",
    ), distinct=True),
    "ma_CartonT": View("lineitem", (
        f"concat('C', CAST({_LINE} AS STRING)) AS CartonNo", "CAST(year(l_shipdate) AS BIGINT) AS SeasonID",
        "CASE WHEN l_linenumber < 7 THEN l_orderkey END AS GraderBatchMPILotID",
        "l_linestatus = 'O' AS CartonExistsFlag",
    )),
    "ma_TransferT": View("orders", (
        "o_orderkey AS TransferID", f"{_SITE} AS FromStorageSiteCompanyID", f"{_MONTH} AS ToStorageSiteCompanyID",
        f"{_DATE} AS TransferDate",
    )),
    "ma_Transfer_BinT": View("lineitem", ("l_orderkey - l_orderkey % 10 AS TransferID", _BIN)),
    "qa_AssessmentT": View("orders", (
        "o_orderkey AS AssessmentID",
        "CASE WHEN o_totalprice >= 20000 THEN o_orderkey - o_orderkey % 3 END AS GraderBatchID",
        "CASE WHEN o_totalprice < 490000 THEN o_orderkey - o_orderkey % 2 END AS GraderBatchMPILotID",
        "o_orderkey AS BinDeliveryID",
        "CAST(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 13 WHEN '2' THEN 14 WHEN '3' THEN 28 ELSE 10 END"
        " AS BIGINT) AS TemplateID",
        _SEASON, "o_custkey AS FarmID", "o_custkey AS BlockID",
        "CASE WHEN o_totalprice NOT BETWEEN 30000 AND 35000 THEN CAST(floor(o_totalprice / 1000) AS BIGINT) END"
        " AS SampleQty",
        "o_orderdate + INTERVAL 13 HOURS AS AssessmentDateTime",
    )),
    "qa_Assessment_DefectT": View("lineitem", (
        f"{_LINE} AS AssessmentDefectID", "l_orderkey AS AssessmentID", "l_partkey AS DefectID",
        "CASE WHEN l_discount > 0 OR l_tax > 0 THEN CAST(l_quantity AS BIGINT) END AS DefectQty",
    )),
    "STG_COMPAC_BATCH": View("lineitem", (
        "l_shipdate AS START_TIME", "l_orderkey AS BATCH_ID",
        "concat('Grower ', CAST(l_suppkey AS STRING)) AS GROWER_NAME", "CAST(l_suppkey AS STRING) AS GROWER_CODE",
        "CASE WHEN l_quantity <= 5 THEN '53/2' WHEN l_quantity <= 10 THEN '53/5' WHEN l_quantity <= 15 THEN '58/5'"
        " WHEN l_quantity <= 20 THEN '63/5' WHEN l_quantity <= 25 THEN '63/3' WHEN l_quantity <= 30 THEN '63/4'"
        " WHEN l_quantity <= 35 THEN '67/4' WHEN l_quantity <= 40 THEN '72/4' WHEN l_quantity <= 44 THEN 'Rejects'"
        " ELSE '80/1' END AS SIZE_NAME",
        "CASE WHEN l_discount = 0 THEN NULL WHEN l_discount <= 0.01 THEN 'Juice'"
        " WHEN l_discount <= 0.02 THEN 'Low Colour' ELSE concat('Class ', l_returnflag) END AS SIZER_GRADE_NAME",
        "l_quantity / 2 + 28 AS MINOR", "l_quantity / 2 + 27 + 100 * l_tax AS MAJOR",
        "l_extendedprice / l_quantity AS WEIGHT", "l_extendedprice / (l_quantity + 2) AS VOLUME",
    )),
    "sw_SeasonT": View("nation", (
        "CAST(1990 + n_nationkey AS BIGINT) AS SeasonID", "CAST(1990 + n_nationkey AS STRING) AS SeasonDesc",
    )),
    "sw_FarmT": View("customer", (
        "c_custkey AS FarmID", "concat('F', CAST(c_custkey AS STRING)) AS FarmCode", "c_name AS FarmName",
        "CAST(c_nationkey AS BIGINT) AS GrowerCompanyID",
    )),
    "sw_Farm_BlockT": View("customer", (
        "c_custkey AS BlockID", "concat('M', CAST(c_custkey AS STRING)) AS BlockCode",
        "CAST(c_nationkey AS BIGINT) AS SubdivisionID",
    )),
    "sw_SubdivisionT": View("nation", (
        "CAST(n_nationkey AS BIGINT) AS SubdivisionID", "concat('S', CAST(n_nationkey AS STRING)) AS SubdivisionCode",
    )),
    "sw_MaturityT": View("nation", (
        "CAST(n_nationkey AS BIGINT) AS MaturityID", "concat('MC', CAST(n_nationkey AS STRING)) AS MaturityCode",
    )),
    "sw_Pick_NoT": View("nation", (
        "CAST(n_nationkey AS BIGINT) AS PickNoID", "concat('Pick ', CAST(n_nationkey AS STRING)) AS PickNoDesc",
        "CAST(n_nationkey AS BIGINT) AS PickNo",
    )),
    "sw_CompanyT": View("nation", ("CAST(n_nationkey AS BIGINT) AS CompanyID", "n_name AS CompanyName")),
    "sw_ProductT": View("part", (
        "p_partkey AS ProductID", "CAST(p_retailprice / 100 AS DECIMAL(18,4)) AS NetFruitWeight",
        "p_size <= 3 AS SampleFlag",
    )),
    "sw_Storage_TypeT": View("nation", (
        "CAST(n_nationkey AS BIGINT) AS StorageTypeID", "concat('Store ', n_name) AS StorageTypeDesc",
    )),
    "qa_DefectT": View("part", (
        "p_partkey AS DefectID", "p_brand AS Defect",
        "CASE WHEN p_type <> 'SMALL' THEN p_type END AS MktDefectCode",
    )),
    "qa_TemplateT": View("nation", (
        "CAST(5 + n_nationkey AS BIGINT) AS TemplateID", "concat('Template ', n_name) AS TemplateName",
    )),
    "pip_Market_RequirementT": View("nation", (
        "CAST(n_regionkey + 1 AS BIGINT) AS PIPReqID",
        "CASE WHEN n_nationkey < 3 THEN 'CHN' WHEN n_nationkey BETWEEN 5 AND 8 THEN 'TWN' ELSE 'USA' END"
        " AS PIPMarketCode",
    )),
    # Requirement 3 has pest rules but no row of its own, so its declaration is unknown.
    "pip_RequirementT": View("nation", (
        "CAST(n_nationkey AS BIGINT) AS PIPReqID", "concat('Free of pest ', n_name) AS DeclarationDesc",
        "concat('G', CAST(n_regionkey AS STRING)) AS PIPGroup",
    ), where="n_nationkey <> 3"),
    "pip_Requirement_PestT": View("part", (
        "CAST(p_size AS BIGINT) AS PIPReqID", "p_type AS MktDefectCode",
        "CAST(0.05 AS DECIMAL(18,4)) AS PercentLimit",
        "CAST(CASE WHEN p_size <= 3 THEN 0 ELSE 1 END AS DECIMAL(18,4)) AS ThresholdQty",
    ), where="p_size <= 7", distinct=True),
}


class SourceTables(Mapping[str, DataFrame]):
    """The source tables by name; a table's plan is made when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._root = spark, sf_dir.rstrip("/")
        self._files: dict[str, DataFrame] = {}
        self._tables: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            view = VIEWS[name]
            if view.source not in self._files:
                self._files[view.source] = self._spark.read.parquet(f"{self._root}/{view.source}.parquet")
            self._tables[name] = view.frame(self._files[view.source])
        return self._tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(VIEWS)

    def __len__(self) -> int:
        return len(VIEWS)


@lru_cache(maxsize=8)
def source_tables(spark: SparkSession, sf_dir: str) -> SourceTables:
    """One set of table handles (plans, no data) per session and directory."""
    return SourceTables(spark, sf_dir)
