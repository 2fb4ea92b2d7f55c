"""Schemas of the source tables, as DDL. Column names are fixed by the source
databases; types are stated here once and used by every reader and test."""

from pyspark.sql.types import StructType

KG = "decimal(18,4)"

_DDL = {
    # facts
    "ma_Bin_DeliveryT": f"""BinDeliveryID bigint, BinDeliveryNo string, SeasonID bigint, FarmID bigint,
        BlockID bigint, MaturityID bigint, PickNoID bigint, StorageTypeID bigint,
        FirstStorageSiteCompanyID bigint, HarvestDate date, NoOfBins bigint, PresizeFlag boolean,
        PresizeProductID bigint, PresizeOutputFromGraderBatchID bigint, TotalWeight {KG}""",
    "ma_BinT": "BinID bigint, BinDeliveryID bigint, GraderBatchID bigint",
    "ma_Bin_UsageT": "BinDeliveryID bigint, GraderBatchID bigint, BinQty bigint",
    "ma_Grader_BatchT": f"""GraderBatchID bigint, GraderBatchNo string, SeasonID bigint, FarmID bigint,
        BlockID bigint, SubdivisionID bigint, MaturityID bigint, PickNoID bigint, StorageTypeID bigint,
        PackingCompanyID bigint, GrowerCompanyID bigint, HarvestDate date, PackDate date,
        InputKgs {KG}, WasteOtherKgs {KG}, ClosedDateTime timestamp_ntz, PresizeInputFlag boolean""",
    "ma_Pallet_DetailT": "GraderBatchID bigint, ProductID bigint, NoOfUnits int",
    "ma_Grader_Batch_MPI_LotT": "GraderBatchMPILotID bigint, GraderBatchID bigint, MPILotNo string",
    "ma_Grader_Batch_MPI_Lot_PIP_RequirementT":
        "GraderBatchMPILotPIPRequirementID bigint, GraderBatchMPILotID bigint, PIPReqID bigint",
    "ma_CartonT": "CartonNo string, SeasonID bigint, GraderBatchMPILotID bigint, CartonExistsFlag boolean",
    "ma_TransferT":
        "TransferID bigint, FromStorageSiteCompanyID bigint, ToStorageSiteCompanyID bigint, TransferDate date",
    "ma_Transfer_BinT": "TransferID bigint, BinID bigint",
    "qa_AssessmentT": """AssessmentID bigint, GraderBatchID bigint, GraderBatchMPILotID bigint,
        BinDeliveryID bigint, TemplateID bigint, SeasonID bigint, FarmID bigint, BlockID bigint,
        SampleQty bigint, AssessmentDateTime timestamp_ntz""",
    "qa_Assessment_DefectT": "AssessmentDefectID bigint, AssessmentID bigint, DefectID bigint, DefectQty bigint",
    "STG_COMPAC_BATCH": """START_TIME timestamp_ntz, BATCH_ID bigint, GROWER_NAME string, GROWER_CODE string,
        SIZE_NAME string, SIZER_GRADE_NAME string, MINOR double, MAJOR double, WEIGHT double, VOLUME double""",
    # dimensions
    "sw_SeasonT": "SeasonID bigint, SeasonDesc string",
    "sw_FarmT": "FarmID bigint, FarmCode string, FarmName string, GrowerCompanyID bigint",
    "sw_Farm_BlockT": "BlockID bigint, BlockCode string, SubdivisionID bigint",
    "sw_SubdivisionT": "SubdivisionID bigint, SubdivisionCode string",
    "sw_MaturityT": "MaturityID bigint, MaturityCode string",
    "sw_Pick_NoT": "PickNoID bigint, PickNoDesc string, PickNo bigint",
    "sw_CompanyT": "CompanyID bigint, CompanyName string",
    "sw_ProductT": f"ProductID bigint, NetFruitWeight {KG}, SampleFlag boolean",
    "sw_Storage_TypeT": "StorageTypeID bigint, StorageTypeDesc string",
    "qa_DefectT": "DefectID bigint, Defect string, MktDefectCode string",
    "qa_TemplateT": "TemplateID bigint, TemplateName string",
    "pip_Market_RequirementT": "PIPReqID bigint, PIPMarketCode string",
    "pip_RequirementT": "PIPReqID bigint, DeclarationDesc string, PIPGroup string",
    "pip_Requirement_PestT":
        f"PIPReqID bigint, MktDefectCode string, PercentLimit {KG}, ThresholdQty {KG}",
}

TABLES = tuple(_DDL)


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(_DDL[table])
