"""DuckDB SQL for every registered query, written apart from the library.

``VIEWS`` gives the source tables; ``DATASETS`` are shared subqueries; ``ORACLES`` the final SELECTs.
Only the subqueries a statement names are put in front of it.
"""

from __future__ import annotations

import re

from cropline_check.views import CURRENT, EXCLUDED, JUICE, MONTH_DAY, PRIOR, SEASONS, SITE, SITES, VIEWS


def out(sql: str, text: str = "", real: str = "", whole: str = "") -> str:
    """Put the named columns of a SELECT in plain types."""
    casts = [
        f'CAST("{c}" AS {kind}) AS "{c}"'
        for names, kind in ((text, "STRING"), (real, "DOUBLE"), (whole, "BIGINT"))
        for c in names.split()
    ]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})" if casts else sql


def close_date(season: str) -> str:
    return f"CAST(concat(CAST({season} AS STRING), '{MONTH_DAY}') AS DATE)"


_IN_EXCLUDED = ", ".join(f"'{c}'" for c in EXCLUDED)
_GRADES = (
    "'Low Colour', 'Leaf', 'Doub', 'Doubles', 'Capt', 'Capture', 'Class 1.5', 'Reject/Spoilt', 'Recycle', 'Juice',"
    " '1.5'"
)

_BATCH_JOINS = """
    JOIN d_season USING (SeasonID) JOIN sw_FarmT f USING (FarmID)
    JOIN sw_CompanyT packer ON packer.CompanyID = b.PackingCompanyID
    JOIN sw_MaturityT m USING (MaturityID) JOIN sw_Pick_NoT p USING (PickNoID)"""

_FANOUT_COLUMNS = """
    b.GraderBatchID AS grader_batch_id, GraderBatchNo AS grader_batch, season, grower.CompanyName AS grower,
    FarmCode AS rpin, FarmName AS orchard, SubdivisionCode AS production_site, HarvestDate AS harvest_date,
    PackDate AS pack_date, packer.CompanyName AS pack_site, n_bins AS bins_tipped, InputKgs AS input_kgs,
    WasteOtherKgs + coalesce(juice_kgs, 0) + coalesce(sample_kgs, 0) AS reject_kgs,
    CAST(CASE WHEN ClosedDateTime IS NULL THEN 0 ELSE 1 END AS BIGINT) AS batch_closed"""


def _fanout(samples: str, site: str) -> str:
    return f"""
    SELECT {_FANOUT_COLUMNS} FROM ma_Grader_BatchT b {_BATCH_JOINS} {site}
    JOIN sw_CompanyT grower ON grower.CompanyID = f.GrowerCompanyID
    LEFT JOIN d_juice j ON j.grader_batch_id = b.GraderBatchID
    LEFT JOIN {samples} s ON s.grader_batch_id = b.GraderBatchID
    LEFT JOIN (SELECT GraderBatchID AS id, count(*) AS n_bins FROM ma_BinT GROUP BY 1) t ON t.id = b.GraderBatchID"""


_SITE_DIRECT = "JOIN sw_SubdivisionT sub ON sub.SubdivisionID = b.SubdivisionID"
_SITE_BY_BLOCK = """JOIN sw_Farm_BlockT blk ON blk.BlockID = b.BlockID
    JOIN sw_SubdivisionT sub ON sub.SubdivisionID = blk.SubdivisionID"""

_KNOWN = "input_kgs IS NOT NULL AND reject_kgs IS NOT NULL AND NOT (input_kgs = 0 AND reject_kgs = 0)"
_PACKOUT = "1 - CAST(reject_kgs AS DOUBLE) / nullif(CAST(input_kgs AS DOUBLE), 0)"
_STATE = """CASE WHEN input_kgs IS NULL OR reject_kgs IS NULL THEN 'missing' WHEN input_kgs <> 0 THEN 'finite'
    WHEN reject_kgs = 0 THEN 'nan' ELSE 'infinite' END"""
_PROP = """(CAST(defect_qty AS DOUBLE) / nullif(CAST(sample_qty AS DOUBLE), 0))
    * (CAST(reject_kgs AS DOUBLE) / nullif(CAST(input_kgs AS DOUBLE), 0))"""


def _ieee_state(x1: str, y1: str, x2: str, y2: str) -> str:
    """State of (x1/y1) * (x2/y2) under floating-point zero rules, for non-negative values."""
    zero_over_zero = f"({x1} = 0 AND {y1} = 0) OR ({x2} = 0 AND {y2} = 0)"
    inf_times_zero = f"({y1} = 0 AND {x2} = 0) OR ({y2} = 0 AND {x1} = 0)"
    return f"""CASE WHEN {x1} IS NULL OR {y1} IS NULL OR {x2} IS NULL OR {y2} IS NULL THEN 'missing'
        WHEN {zero_over_zero} OR {inf_times_zero} THEN 'nan' WHEN {y1} = 0 OR {y2} = 0 THEN 'infinite'
        ELSE 'finite' END"""


_PROP_STATE = _ieee_state("defect_qty", "sample_qty", "reject_kgs", "input_kgs")


def _profile_sums(source: str) -> str:
    return f"""SELECT season, defect, sum(defect_qty) AS defect_qty, sum(sample_qty) AS sample_qty,
        sum(input_kgs) AS input_kgs, sum(reject_kgs) AS reject_kgs
        FROM {source} JOIN d_bounds USING (season) WHERE pack_date >= first_pack AND pack_date < close GROUP BY 1, 2"""


DATASETS: dict[str, str] = {
    "d_season": "SELECT SeasonID, CAST(SeasonDesc AS BIGINT) AS season FROM sw_SeasonT",
    "d_juice": f"""SELECT PresizeOutputFromGraderBatchID AS grader_batch_id, sum(TotalWeight) AS juice_kgs
        FROM ma_Bin_DeliveryT WHERE PresizeProductID = {JUICE} GROUP BY 1""",
    "d_sample_line": """SELECT GraderBatchID AS grader_batch_id, NoOfUnits * NetFruitWeight AS sample_kgs
        FROM ma_Pallet_DetailT JOIN sw_ProductT USING (ProductID) WHERE SampleFlag""",
    "d_sample": "SELECT grader_batch_id, sum(sample_kgs) AS sample_kgs FROM d_sample_line GROUP BY 1",
    "d_delivery": """SELECT season, BinDeliveryID AS bin_delivery_id, HarvestDate AS harvest_date,
        NoOfBins AS no_of_bins, PresizeFlag AS presize_flag, CompanyName AS storage_site, PickNo AS pick_no
        FROM ma_Bin_DeliveryT b JOIN d_season USING (SeasonID) JOIN sw_Pick_NoT USING (PickNoID)
        JOIN sw_CompanyT c ON c.CompanyID = b.FirstStorageSiteCompanyID""",
    "d_tipped": """SELECT b.GraderBatchID AS grader_batch_id, season, PackDate AS pack_date,
        CompanyName AS packing_site, n AS no_of_bins_tipped
        FROM ma_Grader_BatchT b JOIN d_season USING (SeasonID) JOIN sw_CompanyT ON CompanyID = PackingCompanyID
        JOIN (SELECT GraderBatchID, count(*) AS n FROM ma_BinT WHERE GraderBatchID IS NOT NULL GROUP BY 1) t
        ON t.GraderBatchID = b.GraderBatchID""",
    "d_batch": f"""SELECT b.GraderBatchID AS grader_batch_id, season, PackDate AS pack_date,
        HarvestDate AS harvest_date, FarmCode AS farm_code, FarmName AS farm_name,
        SubdivisionCode AS production_site, packer.CompanyName AS pack_site, MaturityCode AS maturity_code,
        StorageTypeDesc AS storage_type, PickNoDesc AS pick_no, InputKgs AS input_kgs,
        WasteOtherKgs + coalesce(juice_kgs, 0) + coalesce(sample_kgs, 0) AS reject_kgs
        FROM ma_Grader_BatchT b {_BATCH_JOINS} {_SITE_DIRECT}
        JOIN sw_Storage_TypeT st ON st.StorageTypeID = b.StorageTypeID
        LEFT JOIN d_juice j ON j.grader_batch_id = b.GraderBatchID
        LEFT JOIN d_sample s ON s.grader_batch_id = b.GraderBatchID
        WHERE NOT PresizeInputFlag""",
    "d_fanout": _fanout("d_sample_line", _SITE_DIRECT),
    "d_site_batch": f"""SELECT *, date_diff('day', harvest_date, pack_date) AS storage_days,
        {_PACKOUT} AS packout, {_STATE} AS packout_state FROM d_batch WHERE pack_site = '{SITE}'""",
    "d_firsts": f"""SELECT season, min(harvest_date) AS first_harvest, min(pack_date) AS first_pack
        FROM d_batch WHERE pack_site = '{SITE}' AND {_KNOWN} GROUP BY season""",
    "d_bounds": f"SELECT *, {close_date('season')} AS close FROM d_firsts",
    "d_harvest_total": """SELECT season, CAST(sum(no_of_bins) AS BIGINT) AS bins
        FROM d_delivery JOIN d_bounds USING (season)
        WHERE NOT presize_flag AND harvest_date BETWEEN first_harvest AND close GROUP BY season""",
    "d_tipped_total": """SELECT season, CAST(sum(no_of_bins_tipped) AS BIGINT) AS bins
        FROM d_tipped JOIN d_bounds USING (season) WHERE pack_date <= close GROUP BY season""",
    "d_packout_to_date": f"""SELECT season, CAST(input_kgs AS DOUBLE) AS input_kgs,
        CAST(reject_kgs AS DOUBLE) AS reject_kgs, {_PACKOUT} AS packout FROM (
        SELECT season, sum(input_kgs) AS input_kgs, sum(reject_kgs) AS reject_kgs
        FROM d_site_batch JOIN d_bounds USING (season)
        WHERE {_KNOWN} AND pack_date >= first_pack AND pack_date < close GROUP BY season)""",
    "d_closed": f"""SELECT *, date_diff('day', harvest_date, pack_date) AS storage_days, {_PACKOUT} AS packout
        FROM d_fanout WHERE pack_site = '{SITE}' AND batch_closed = 1""",
    "d_capped": f"""SELECT * FROM d_closed
        WHERE storage_days <= (SELECT max(storage_days) FROM d_closed WHERE season = {CURRENT})""",
    "d_fit": """SELECT season, CAST(count(*) AS BIGINT) AS n, regr_intercept(packout, storage_days) AS intercept,
        regr_slope(packout, storage_days) AS slope, avg(storage_days) AS mean_days,
        var_pop(storage_days) * count(*) AS sxx,
        var_pop(packout) * count(*) - regr_slope(packout, storage_days)
          * covar_pop(packout, storage_days) * count(*) AS sse,
        min(storage_days) AS min_days, max(storage_days) AS max_days
        FROM d_capped WHERE packout IS NOT NULL GROUP BY season""",
    "d_regression": """SELECT season, n, intercept, slope,
        sqrt(s2 * (1.0 / n + mean_days * mean_days / sxx)) AS se_intercept, sqrt(s2 / sxx) AS se_slope,
        mean_days, sxx, min_days, max_days, sqrt(sse / (n - 2)) AS sd_resid
        FROM d_fit, (SELECT sum(sse) / (sum(n) - 2 * count(*)) AS s2 FROM d_fit)""",
    "d_assessment": """SELECT AssessmentID AS assessment_id, season, GraderBatchID AS grader_batch_id,
        TemplateName AS template_name, BinDeliveryID AS bin_delivery_id, AssessmentDateTime AS assessed_at,
        SampleQty AS sample_qty FROM qa_AssessmentT JOIN qa_TemplateT USING (TemplateID) JOIN d_season USING (SeasonID)
        WHERE TemplateID IN (13, 14, 28)""",
    "d_defect": """SELECT AssessmentDefectID AS assessment_defect_id, AssessmentID AS assessment_id,
        Defect AS defect, DefectQty AS defect_qty FROM qa_Assessment_DefectT JOIN qa_DefectT USING (DefectID)""",
    "d_sample_qty": """SELECT grader_batch_id, CAST(coalesce(sum(sample_qty), 0) AS BIGINT) AS sample_qty
        FROM d_assessment GROUP BY grader_batch_id""",
    "d_sample_qty_to_date": """SELECT grader_batch_id, CAST(coalesce(sum(sample_qty), 0) AS BIGINT) AS sample_qty
        FROM d_assessment JOIN d_bounds USING (season)
        WHERE CAST(assessed_at AS DATE) >= first_pack AND CAST(assessed_at AS DATE) < close
        GROUP BY grader_batch_id""",
    "d_defect_by_batch": """SELECT grader_batch_id, defect,
        CAST(CASE WHEN bool_or(defect_qty IS NULL) THEN NULL ELSE sum(defect_qty) END AS BIGINT) AS defect_qty
        FROM d_defect JOIN d_assessment USING (assessment_id) GROUP BY 1, 2""",
    "d_prop_all": f"""SELECT grader_batch_id, defect, defect_qty, sample_qty, season, pack_date, input_kgs, reject_kgs,
        {_PROP} AS prop, {_PROP_STATE} AS prop_state
        FROM d_defect_by_batch JOIN d_sample_qty_to_date USING (grader_batch_id)
        LEFT JOIN (SELECT grader_batch_id, season, pack_date, input_kgs, reject_kgs FROM d_batch)
        USING (grader_batch_id)""",
    "d_prop": "SELECT * FROM d_prop_all WHERE prop_state NOT IN ('missing', 'nan')",
    "d_profile": f"SELECT *, {_PROP} AS prop FROM ({_profile_sums('d_prop')})",
    "d_top": f"""SELECT defect, row_number() OVER (ORDER BY prop DESC NULLS FIRST, defect DESC) AS rank
        FROM d_profile WHERE season = {CURRENT} QUALIFY rank <= 15""",
    "d_rule": """SELECT DISTINCT q.PIPReqID AS pip_req_id, p.MktDefectCode AS mkt_defect_code,
        r.DeclarationDesc AS declaration
        FROM pip_Market_RequirementT q JOIN pip_Requirement_PestT p ON p.PIPReqID = q.PIPReqID
        LEFT JOIN pip_RequirementT r ON r.PIPReqID = p.PIPReqID
        WHERE q.PIPMarketCode IN ('CHN', 'TWN') AND p.ThresholdQty = 0""",
    "d_pest": """SELECT AssessmentDefectID AS assessment_defect_id, a.AssessmentID AS assessment_id, season,
        GraderBatchID AS grader_batch_id, GraderBatchMPILotID AS lot_id, Defect AS defect, DefectQty AS defect_qty,
        SampleQty AS sample_qty, MktDefectCode AS mkt_defect_code, AssessmentDateTime AS assessed_at
        FROM qa_Assessment_DefectT l JOIN qa_DefectT USING (DefectID)
        JOIN qa_AssessmentT a ON a.AssessmentID = l.AssessmentID JOIN d_season USING (SeasonID)
        WHERE MktDefectCode IS NOT NULL AND TemplateID = 10""",
    "d_finding": """SELECT d_pest.* FROM d_pest JOIN d_rule ON d_rule.mkt_defect_code = d_pest.mkt_defect_code""",
    "d_lot": """SELECT GraderBatchMPILotID AS lot_id, b.*, MPILotNo AS lot_no, season
        FROM ma_Grader_Batch_MPI_LotT l JOIN ma_Grader_BatchT b ON b.GraderBatchID = l.GraderBatchID
        JOIN d_season USING (SeasonID)""",
    "d_lot_detail": """SELECT lot_id, GraderBatchID AS grader_batch_id, lot_no, FarmCode AS rpin, FarmName AS orchard,
        SubdivisionCode AS production_site, PackDate AS pack_date, HarvestDate AS harvest_date
        FROM d_lot JOIN sw_FarmT USING (FarmID) JOIN sw_SubdivisionT USING (SubdivisionID)""",
    "d_lot_requirement": """SELECT GraderBatchMPILotPIPRequirementID AS lot_requirement_id,
        GraderBatchMPILotID AS lot_id, q.PIPReqID AS pip_req_id, DeclarationDesc AS declaration,
        PIPGroup AS pip_group, MktDefectCode AS mkt_defect_code, PercentLimit AS percent_limit,
        ThresholdQty AS threshold_qty
        FROM ma_Grader_Batch_MPI_Lot_PIP_RequirementT q JOIN pip_RequirementT r ON r.PIPReqID = q.PIPReqID
        JOIN pip_Requirement_PestT p ON p.PIPReqID = q.PIPReqID""",
    "d_lot_summary": """SELECT * FROM (SELECT lot_id, defect, mkt_defect_code, max(season) AS season,
        CAST(coalesce(sum(defect_qty), 0) AS BIGINT) AS defect_qty,
        CAST(coalesce(sum(sample_qty), 0) AS BIGINT) AS sample_qty FROM d_finding GROUP BY 1, 2, 3)
        JOIN d_lot_detail USING (lot_id)""",
    "d_lot_finding": """SELECT *, date_diff('day', harvest_date, pack_date) AS storage_days
        FROM d_lot_summary JOIN d_lot_requirement USING (lot_id, mkt_defect_code)""",
    "d_pest_count": """SELECT season, defect, CAST(CASE WHEN bool_or(defect_qty IS NULL) THEN NULL
        ELSE sum(defect_qty) END AS BIGINT) AS defect_qty
        FROM d_finding JOIN d_bounds USING (season) WHERE CAST(assessed_at AS DATE) <= close GROUP BY 1, 2""",
    "d_packed_fruit": f"""SELECT CAST(year(START_TIME) AS BIGINT) AS season, BATCH_ID AS batch_id,
        GROWER_NAME AS grower_name, GROWER_CODE AS grower_code, MINOR AS minor, MAJOR AS major, WEIGHT AS weight,
        VOLUME AS volume, SIZE_NAME AS size_name, SIZER_GRADE_NAME AS grade, START_TIME AS start_time,
        round(MAJOR / MINOR, 8) AS elongation, MAJOR / MINOR AS el FROM STG_COMPAC_BATCH
        WHERE SIZER_GRADE_NAME NOT IN ({_GRADES}) AND SIZE_NAME <> 'Rejects' AND MINOR > 30 AND MAJOR > 30""",
    "d_fruit": f"""SELECT * FROM d_packed_fruit WHERE season BETWEEN {SEASONS[1]} AND {SEASONS[-1]}
        AND start_time > make_timestamp(season, 1, 1, 0, 0, 0.0) AND start_time <= {close_date('season')}""",
    "d_moments": """SELECT season, avg(minor) AS mean_eq, stddev_samp(minor) AS sd_eq, avg(major) AS mean_sl,
        stddev_samp(major) AS sd_sl, avg(el) AS mean_elong, stddev_samp(el) AS sd_elong, avg(weight) AS mean_mass,
        stddev_samp(weight) AS sd_mass, avg(volume) AS mean_vol, stddev_samp(volume) AS sd_vol,
        covar_samp(minor, el) AS covar FROM d_fruit GROUP BY season""",
    # The finite sums over powers of the cosine for whole degrees of freedom, solved for t by halving.
    "d_t975": """WITH RECURSIVE b AS (
          SELECT DISTINCT df, 0::DOUBLE AS lo, 14::DOUBLE AS hi, 0 AS i FROM (
            SELECT count(*) - 2 AS df FROM d_site_batch GROUP BY season, pack_date UNION ALL SELECT n - 2 FROM d_regression) WHERE df > 0
          UNION ALL SELECT df, CASE WHEN p < 0.95 THEN mid ELSE lo END, CASE WHEN p < 0.95 THEN hi ELSE mid END, i + 1 FROM (
            SELECT *, CASE WHEN df % 2 = 0 THEN sin(a) * list_reduce(range(df // 2 - 1, 0, -1), lambda s, k: 1 + (2 * k - 1) / (2.0 * k) * c2 * s, 1.0::DOUBLE)
              WHEN df = 1 THEN 2 / pi() * a
              ELSE 2 / pi() * (a + sin(a) * cos(a) * list_reduce(range((df - 3) // 2, 0, -1), lambda s, k: 1 + 2 * k / (2.0 * k + 1) * c2 * s, 1.0::DOUBLE)) END AS p
            FROM (SELECT *, atan(mid / sqrt(df)) AS a, cos(atan(mid / sqrt(df))) ** 2 AS c2 FROM (
              SELECT *, (lo + hi) / 2 AS mid FROM b WHERE i < 55))))
        SELECT df, (lo + hi) / 2 AS q FROM b WHERE i = 55""",
    "d_band": f"""SELECT batch_id, band, count(*) AS n,
        count(*) / CAST(sum(count(*)) OVER (PARTITION BY batch_id) AS DOUBLE) AS share FROM (
        SELECT batch_id, CASE WHEN size_name IN ('53/2', '53/5', '58/5', '63/5') THEN 'FP'
          WHEN size_name IN ('63/3', '63/4', '67/4', '72/4') THEN 'Tube' ELSE 'OOS' END AS band
        FROM d_packed_fruit WHERE season = {PRIOR}) GROUP BY batch_id, band""",
    "d_band_wide": """SELECT batch_id, coalesce(max(share) FILTER (band = 'FP'), 0) AS "FP",
        coalesce(max(share) FILTER (band = 'Tube'), 0) AS "Tube", coalesce(max(share) FILTER (band = 'OOS'), 0) AS "OOS"
        FROM d_band GROUP BY batch_id""",
    "d_pick": """SELECT *, bins / CAST(sum(bins) OVER (PARTITION BY season) AS DOUBLE) AS share FROM (
        SELECT season, pick_no, CAST(sum(no_of_bins) AS BIGINT) AS bins FROM d_delivery GROUP BY 1, 2)""",
    "d_duration": """SELECT season, min(harvest_date) AS first_harvest, max(harvest_date) AS last_harvest,
        CAST(sum(no_of_bins) AS BIGINT) AS bins,
        date_diff('day', min(harvest_date), max(harvest_date)) AS harvest_days
        FROM d_delivery WHERE NOT presize_flag GROUP BY season""",
    "d_kpi": """SELECT b.season, b.first_harvest, d.last_harvest, b.first_pack,
        date_diff('day', b.first_pack, b.close) AS days_packing, h.bins,
        d.bins / CAST(nullif(d.harvest_days, 0) AS DOUBLE) AS bins_per_day, p.share AS first_pick_share,
        t.bins AS bins_tipped, k.packout
        FROM d_bounds b LEFT JOIN d_duration d USING (season) LEFT JOIN d_harvest_total h USING (season)
        LEFT JOIN (SELECT * FROM d_pick WHERE pick_no = 1) p USING (season)
        LEFT JOIN d_tipped_total t USING (season) LEFT JOIN d_packout_to_date k USING (season)""",
    "d_site_bins": """SELECT season, storage_site, no_of_bins FROM d_delivery JOIN d_bounds USING (season)
        WHERE NOT presize_flag AND harvest_date BETWEEN first_harvest AND close""",
    "d_site_wide": "SELECT season, " + ", ".join(
        f"CAST(coalesce(sum(no_of_bins) FILTER (storage_site = '{s}'), 0) AS BIGINT) AS \"{s}\"" for s in SITES[:2]
    ) + f""", CAST(coalesce(sum(no_of_bins) FILTER (storage_site NOT IN ('{SITES[0]}', '{SITES[1]}')), 0) AS BIGINT) AS other_sites,
        CAST(coalesce(sum(no_of_bins) FILTER (storage_site IS NULL), 0) AS BIGINT) AS no_site,
        CAST(sum(no_of_bins) AS BIGINT) AS total FROM d_site_bins GROUP BY season""",
    "d_site_shares": "SELECT season, CAST(sum(no_of_bins) AS BIGINT) AS total, " + ", ".join(
        f"CAST(coalesce(sum(no_of_bins) FILTER (storage_site = '{s}'), 0) AS BIGINT) AS \"{s}\"" for s in SITES
    ) + " FROM d_site_bins GROUP BY season",
}

_PROP_COLUMNS = "grader_batch_id, defect, defect_qty, sample_qty, season, pack_date, input_kgs, reject_kgs"
def _rounded(source: str, digits: int, columns: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in columns.split())}) FROM {source}"


ORACLES: dict[str, str] = {
    "bins_harvested": out(
        """SELECT season, BinDeliveryID AS bin_delivery_id, HarvestDate AS harvest_date, NoOfBins AS no_of_bins,
        PresizeFlag AS presize_flag, CompanyName AS storage_site FROM ma_Bin_DeliveryT JOIN d_season USING (SeasonID)
        JOIN sw_CompanyT ON CompanyID = FirstStorageSiteCompanyID""", text="harvest_date"),
    "bins_harvested_pick": out("SELECT * FROM d_delivery", text="harvest_date"),
    "bins_tipped": out("SELECT * FROM d_tipped", text="pack_date"),
    "batch_detail": out("SELECT * FROM d_batch", text="pack_date harvest_date", real="input_kgs reject_kgs"),
    "batch_detail_fanout": out("SELECT * FROM d_fanout", text="pack_date harvest_date", real="input_kgs reject_kgs"),
    "batch_one_row": out(_fanout("d_sample", _SITE_DIRECT), text="pack_date harvest_date", real="input_kgs reject_kgs"),
    "batch_by_block": out(
        _fanout("d_sample_line", _SITE_BY_BLOCK), text="pack_date harvest_date", real="input_kgs reject_kgs"),
    "sql_grader_batch": out("SELECT * FROM d_fanout", text="pack_date harvest_date", real="input_kgs reject_kgs"),
    "sql_grader_batch_by_block": out(
        _fanout("d_sample_line", _SITE_BY_BLOCK), text="pack_date harvest_date", real="input_kgs reject_kgs"),
    "batch_dates": """SELECT season, GraderBatchID AS grader_batch_id, CAST(HarvestDate AS STRING) AS harvest_date,
        CAST(PackDate AS STRING) AS pack_date FROM ma_Grader_BatchT JOIN d_season USING (SeasonID)""",
    "juice_kgs": out("SELECT * FROM d_juice", real="juice_kgs"),
    "sample_kgs": out("SELECT * FROM d_sample", real="sample_kgs"),
    "bin_delivery": """SELECT season, d.BinDeliveryID AS bin_delivery_id, BinDeliveryNo AS bin_delivery_no,
        FarmCode AS rpin, FarmName AS orchard, g.CompanyName AS grower, SubdivisionCode AS production_site,
        BlockCode AS management_area, CAST(HarvestDate AS STRING) AS harvest_date, NoOfBins AS bins_received,
        coalesce(n, 0) AS bins_assigned_for_tipping, NoOfBins - coalesce(n, 0) AS bins_in_storage,
        MaturityCode AS submission_profile, PickNoDesc AS pick_no, c.CompanyName AS storage_site,
        CASE StorageTypeID WHEN 4 THEN 'CA' ELSE 'RA' END AS storage_type,
        CASE StorageTypeID WHEN 6 THEN 'No 1-MCP applied' ELSE '1-MCP applied' END AS smart_freshed
        FROM ma_Bin_DeliveryT d JOIN d_season USING (SeasonID) JOIN sw_FarmT f USING (FarmID)
        JOIN sw_Farm_BlockT USING (BlockID) JOIN sw_SubdivisionT USING (SubdivisionID)
        JOIN sw_MaturityT USING (MaturityID) JOIN sw_Pick_NoT USING (PickNoID)
        JOIN sw_CompanyT c ON c.CompanyID = d.FirstStorageSiteCompanyID
        JOIN sw_CompanyT g ON g.CompanyID = f.GrowerCompanyID
        LEFT JOIN (SELECT BinDeliveryID, count(BinID) AS n FROM ma_BinT WHERE GraderBatchID IS NOT NULL GROUP BY 1) t
        ON t.BinDeliveryID = d.BinDeliveryID WHERE NOT PresizeFlag""",
    "bin_usage": """SELECT BinDeliveryID AS bin_delivery_id,
        CAST(CASE WHEN ClosedDateTime IS NULL THEN 0 ELSE 1 END AS BIGINT) AS bins_tipped,
        CAST(sum(BinQty) AS BIGINT) AS bin_qty
        FROM ma_Bin_UsageT JOIN ma_Grader_BatchT USING (GraderBatchID) GROUP BY 1, 2""",
    "bins_for_batch": """SELECT season, GraderBatchID AS grader_batch_id, BinDeliveryID AS bin_delivery_id,
        count(BinID) AS bins_tipped FROM ma_BinT JOIN ma_Grader_BatchT USING (GraderBatchID)
        JOIN d_season USING (SeasonID) GROUP BY 1, 2, 3""",
    "transfers": """SELECT n.BinDeliveryID AS bin_delivery_id, BinDeliveryNo AS bin_delivery_no,
        GraderBatchID AS grader_batch_id, CAST(TransferDate AS STRING) AS transfer_date,
        a.CompanyName AS from_storage_site, z.CompanyName AS to_storage_site
        FROM ma_BinT n JOIN ma_Transfer_BinT USING (BinID) JOIN ma_TransferT h USING (TransferID)
        JOIN ma_Bin_DeliveryT d ON d.BinDeliveryID = n.BinDeliveryID
        JOIN sw_CompanyT a ON a.CompanyID = h.FromStorageSiteCompanyID
        JOIN sw_CompanyT z ON z.CompanyID = h.ToStorageSiteCompanyID""",
    "defect_assessments": out("SELECT * FROM d_assessment", text="assessed_at"),
    "defects": "SELECT * FROM d_defect",
    "defect_assessment_summary": """SELECT season, FarmCode AS rpin, FarmName AS orchard,
        SubdivisionCode AS production_site, BlockCode AS management_area, a.GraderBatchID AS grader_batch_id,
        Defect AS defect, CAST(sum(DefectQty) AS BIGINT) AS defect_qty, CAST(any_value(q.qty) AS BIGINT) AS sample_qty
        FROM qa_Assessment_DefectT JOIN qa_AssessmentT a USING (AssessmentID) JOIN qa_DefectT USING (DefectID)
        JOIN sw_FarmT USING (FarmID) JOIN sw_Farm_BlockT USING (BlockID) JOIN sw_SubdivisionT USING (SubdivisionID)
        JOIN d_season USING (SeasonID)
        LEFT JOIN (SELECT GraderBatchID, sum(SampleQty) AS qty FROM qa_AssessmentT
          WHERE TemplateID IN (13, 14, 28) GROUP BY 1) q ON q.GraderBatchID = a.GraderBatchID
        WHERE TemplateID IN (13, 14, 28) GROUP BY 1, 2, 3, 4, 5, 6, 7""",
    "market_rules": "SELECT * FROM d_rule",
    "phyto_findings": out("SELECT * FROM d_finding", text="assessed_at"),
    "phyto_findings_once": out(
        "SELECT * FROM d_pest WHERE mkt_defect_code IN (SELECT mkt_defect_code FROM d_rule)", text="assessed_at"),
    "phyto_findings_all": "SELECT * EXCLUDE (assessed_at) FROM d_pest",
    "lot_detail": out("SELECT * FROM d_lot_detail", text="pack_date harvest_date"),
    "lot_detail_older": out("SELECT * EXCLUDE (production_site) FROM d_lot_detail", text="pack_date harvest_date"),
    "lot_sites": """SELECT lot_id, GraderBatchID AS grader_batch_id, g.CompanyName AS grower, FarmCode AS rpin,
        FarmName AS orchard, SubdivisionCode AS production_site, p.CompanyName AS packing_site
        FROM d_lot l JOIN sw_FarmT USING (FarmID) JOIN sw_SubdivisionT USING (SubdivisionID)
        JOIN sw_CompanyT g ON g.CompanyID = l.GrowerCompanyID JOIN sw_CompanyT p ON p.CompanyID = l.PackingCompanyID""",
    "lot_dates": """SELECT lot_id, GraderBatchID AS grader_batch_id, CAST(PackDate AS STRING) AS pack_date, season
        FROM d_lot""",
    "lot_requirements": out("SELECT * FROM d_lot_requirement", real="percent_limit threshold_qty"),
    "cartons_by_lot": """SELECT season, GraderBatchMPILotID AS lot_id, count(CartonNo) AS cartons
        FROM ma_CartonT JOIN d_season USING (SeasonID) WHERE CartonExistsFlag GROUP BY 1, 2""",
    "fruit_measurements": out("SELECT * EXCLUDE (el) FROM d_fruit", text="start_time"),
    "season_bounds": out("SELECT * FROM d_bounds", text="first_harvest first_pack close"),
    "season_bounds_week": out(
        "SELECT *, first_pack + 7 AS close FROM d_firsts", text="first_harvest first_pack close"),
    "season_bounds_prior_db": out(
        f"""SELECT season, min(HarvestDate) AS first_harvest, min(PackDate) AS first_pack, {close_date('season')} AS close
        FROM ma_Grader_BatchT JOIN d_season USING (SeasonID) WHERE season IN ({PRIOR - 2}, {PRIOR - 1})
        GROUP BY season""", text="first_harvest first_pack close"),
    "season_to_date": out(
        """SELECT grader_batch_id, season, pack_date FROM d_site_batch JOIN d_bounds USING (season)
        WHERE pack_date >= first_pack AND pack_date < close""", text="pack_date"),
    "season_to_date_twice": out(
        """SELECT grader_batch_id, season, pack_date FROM d_site_batch JOIN d_bounds USING (season)
        WHERE pack_date >= first_pack AND pack_date < close""", text="pack_date"),
    "season_to_date_many": """SELECT grader_batch_id, date_diff('day', DATE '1990-01-01', pack_date) AS season,
        CAST(pack_date AS STRING) AS pack_date FROM d_batch""",
    "season_to_date_joined": out(
        """SELECT bin_delivery_id, season, harvest_date FROM d_delivery JOIN d_bounds USING (season)
        WHERE harvest_date BETWEEN first_harvest AND close""", text="harvest_date"),
    "harvest_by_site": "SELECT * FROM d_site_wide",
    "harvest_duration": out(
        "SELECT * EXCLUDE (bins) FROM d_duration", text="first_harvest last_harvest"),
    "harvest_rate": f"""SELECT season, bins, harvest_days, bins / CAST(nullif(harvest_days, 0) AS DOUBLE) AS bins_per_day
        FROM d_duration WHERE season IN ({PRIOR}, {CURRENT})""",
    "harvest_growth": f"""SELECT (b1 / d1 - b0 / d0) / (b0 / d1) AS growth_as_published,
        (b1 / d1 - b0 / d0) / (b0 / d0) AS growth_consistent, (b1 - b0) / b0 AS total_growth FROM (
        SELECT CAST(max(bins) FILTER (season = {CURRENT}) AS DOUBLE) AS b1,
          CAST(max(bins) FILTER (season = {PRIOR}) AS DOUBLE) AS b0,
          CAST(max(close - first_harvest) FILTER (season = {CURRENT}) AS DOUBLE) AS d1,
          CAST(max(close - first_harvest) FILTER (season = {PRIOR}) AS DOUBLE) AS d0
        FROM d_harvest_total JOIN d_bounds USING (season))""",
    "pick_share": "SELECT * FROM d_pick",
    "cumulative_harvest": f"""SELECT season, CAST(harvest_date AS STRING) AS harvest_date, bins,
        CAST(sum(bins) OVER (PARTITION BY season ORDER BY harvest_date) AS BIGINT) AS cum_bins, plot_date FROM (
        SELECT season, harvest_date, CAST(sum(no_of_bins) AS BIGINT) AS bins,
          strftime(harvest_date, '2024-%m-%d') AS plot_date
        FROM d_delivery JOIN d_bounds USING (season)
        WHERE NOT presize_flag AND harvest_date BETWEEN first_harvest AND close GROUP BY 1, 2)
        WHERE plot_date <= '2024{MONTH_DAY}'""",
    "tipped_by_site": f"""WITH s AS (SELECT packing_site,
          CAST(coalesce(sum(no_of_bins_tipped) FILTER (season = {PRIOR}), 0) AS BIGINT) AS prior,
          CAST(coalesce(sum(no_of_bins_tipped) FILTER (season = {CURRENT}), 0) AS BIGINT) AS current
          FROM d_tipped JOIN d_bounds USING (season) WHERE pack_date <= close GROUP BY 1)
        SELECT * FROM s UNION ALL SELECT 'Total', CAST(sum(prior) AS BIGINT), CAST(sum(current) AS BIGINT) FROM s""",
    "tipped_growth": f"""SELECT (a.bins - b.bins) / CAST(b.bins AS DOUBLE) AS growth
        FROM d_tipped_total a, d_tipped_total b WHERE a.season = {CURRENT} AND b.season = {PRIOR}""",
    "packout_by_batch": """SELECT grader_batch_id, season, CAST(pack_date AS STRING) AS pack_date,
        CAST(storage_days AS BIGINT) AS storage_days, CAST(weekofyear(pack_date) AS BIGINT) AS iso_week, packout,
        packout_state FROM d_site_batch""",
    "known_packout": f"SELECT grader_batch_id, packout, packout_state FROM d_site_batch WHERE {_KNOWN}",
    "packout_scatter": f"""SELECT CAST(pack_date AS STRING) AS pack_date, packout, packout_state FROM d_site_batch
        WHERE season = {CURRENT} AND {_KNOWN}""",
    "packout_to_date": "SELECT * FROM d_packout_to_date",
    "packout_in_bounds": "SELECT * FROM d_packout_to_date",
    "packout_to_date_closed": f"""SELECT season, CAST(i AS DOUBLE) AS input_kgs, CAST(r AS DOUBLE) AS reject_kgs,
        1 - CAST(r AS DOUBLE) / CAST(i AS DOUBLE) AS packout FROM (
        SELECT season, sum(input_kgs) AS i, sum(reject_kgs) AS r FROM d_site_batch JOIN d_bounds USING (season)
        WHERE {_KNOWN} AND pack_date BETWEEN first_pack AND close GROUP BY season)""",
    "packout_first_week": f"""SELECT season, CAST(i AS DOUBLE) AS input_kgs, CAST(r AS DOUBLE) AS reject_kgs,
        1 - CAST(r AS DOUBLE) / CAST(i AS DOUBLE) AS packout FROM (
        SELECT season, sum(input_kgs) AS i, sum(reject_kgs) AS r FROM d_site_batch JOIN d_firsts USING (season)
        WHERE {_KNOWN} AND pack_date >= first_pack AND pack_date < first_pack + 7
        AND season IN ({PRIOR}, {CURRENT}) GROUP BY season)""",
    "packout_whole_season": f"""SELECT season, CAST(i AS DOUBLE) AS input_kgs, CAST(r AS DOUBLE) AS reject_kgs,
        1 - CAST(r AS DOUBLE) / CAST(i AS DOUBLE) AS packout FROM (
        SELECT season, sum(input_kgs) AS i, sum(reject_kgs) AS r FROM d_site_batch
        WHERE {_KNOWN} AND season = {CURRENT} GROUP BY season)""",
    "packout_population": """SELECT season, CAST(i AS DOUBLE) AS input_kgs, CAST(r AS DOUBLE) AS reject_kgs,
        1 - CAST(r AS DOUBLE) / CAST(i AS DOUBLE) AS packout FROM (
        SELECT season, coalesce(sum(input_kgs), 0) AS i, coalesce(sum(reject_kgs), 0) AS r
        FROM d_batch JOIN d_bounds USING (season) WHERE pack_date >= first_pack AND pack_date < close GROUP BY season)""",
    "storage_day_points": f"""SELECT grader_batch_id, season, CAST(storage_days AS BIGINT) AS storage_days,
        CASE WHEN input_kgs IS NULL OR reject_kgs IS NULL THEN 'missing' WHEN input_kgs <> 0 THEN 'finite'
          WHEN reject_kgs = 0 THEN 'nan' ELSE 'infinite' END AS packout_state FROM d_capped WHERE season = {CURRENT}""",
    "storage_day_cap": """SELECT season, count(storage_days) AS n, CAST(max(storage_days) AS BIGINT) AS longest
        FROM d_capped GROUP BY season""",
    "packout_regression": _rounded(
        "(" + _rounded("d_regression", 8, "intercept slope se_intercept se_slope mean_days sd_resid") + ")", 4, "sxx"),
    "packout_slope_ratio": f"""SELECT round(a.slope / b.slope, 8) AS ratio FROM d_fit a, d_fit b
        WHERE a.season = {PRIOR} AND b.season = {CURRENT}""",
    "packout_trend_line": """SELECT season, storage_days, round(fit, 8) AS fit, round(se_fit, 8) AS se_fit,
        round(fit - q * se_fit, 8) AS lower, round(fit + q * se_fit, 8) AS upper FROM (
        SELECT season, storage_days, intercept + slope * storage_days AS fit,
          sd_resid * sqrt(1.0 / n + (storage_days - mean_days) ** 2 / sxx) AS se_fit, q
        FROM (SELECT *, CAST(unnest(generate_series(min_days, max_days)) AS BIGINT) AS storage_days FROM d_regression)
          LEFT JOIN d_t975 ON df = n - 2)""",
    "t_quantiles": """SELECT season, CAST(pack_date AS STRING) AS pack_date, n,
        round(q, 8) AS q FROM (
        SELECT season, pack_date, count(*) AS n FROM d_site_batch GROUP BY 1, 2) LEFT JOIN d_t975 ON df = n - 2""",
    "sample_qty": "SELECT * FROM d_sample_qty",
    "sample_qty_to_date": "SELECT * FROM d_sample_qty_to_date",
    "batch_defects": out(
        f"""SELECT {_PROP_COLUMNS}, prop, prop_state FROM d_prop""",
        text="pack_date", real="input_kgs reject_kgs"),
    "batch_defects_by_input": out(
        f"""SELECT {_PROP_COLUMNS}, CASE WHEN {_PROP_STATE} = 'finite' THEN {_PROP} END AS prop,
        {_PROP_STATE} AS prop_state
        FROM d_defect_by_batch JOIN d_sample_qty USING (grader_batch_id)
        LEFT JOIN (SELECT grader_batch_id, season, pack_date, input_kgs, reject_kgs FROM d_batch)
        USING (grader_batch_id) WHERE input_kgs IS NOT NULL""", text="pack_date", real="input_kgs reject_kgs"),
    "defect_profile": out(
        "SELECT * FROM d_profile", real="input_kgs reject_kgs", whole="defect_qty sample_qty"),
    "defects_first_week": out(
        f"""SELECT *, {_PROP} AS prop FROM (SELECT season, defect, {', '.join(
            f'CASE WHEN count({c}) = count(*) THEN sum({c}) END AS {c}' for c in ('defect_qty', 'sample_qty', 'input_kgs', 'reject_kgs'))}
        FROM d_defect_by_batch JOIN d_sample_qty USING (grader_batch_id)
        JOIN (SELECT grader_batch_id, season, pack_date, input_kgs, reject_kgs FROM d_batch WHERE input_kgs IS NOT NULL)
        USING (grader_batch_id) JOIN d_firsts USING (season)
        WHERE season IN ({PRIOR}, {CURRENT}) AND pack_date >= first_pack AND pack_date < first_pack + 7 GROUP BY season, defect)""",
        real="input_kgs reject_kgs", whole="defect_qty sample_qty"),
    "top_defects": out(
        "SELECT * FROM d_profile JOIN d_top USING (defect)",
        real="input_kgs reject_kgs", whole="defect_qty sample_qty"),
    "top_defect_lines": "SELECT * FROM d_defect WHERE defect IN (SELECT defect FROM d_top)",
    "null_safe_join": """SELECT f.grader_batch_id, defect, defect_qty, sample_qty FROM d_defect_by_batch f
        JOIN d_sample_qty s ON s.grader_batch_id IS NOT DISTINCT FROM f.grader_batch_id""",
    "phyto_lot_summary": out("SELECT * FROM d_lot_summary", text="pack_date harvest_date"),
    "phyto_with_requirements": out(
        "SELECT * FROM d_lot_finding", text="pack_date harvest_date", real="percent_limit threshold_qty"),
    "phyto_with_lot_requirements": out(
        "SELECT * FROM d_lot_finding", text="pack_date harvest_date", real="percent_limit threshold_qty"),
    "interception_rate": f"""SELECT season, with_interceptions, total,
        with_interceptions / CAST(total AS DOUBLE) AS rate FROM
        (SELECT season, count(DISTINCT lot_id) AS with_interceptions FROM d_lot_finding JOIN d_bounds USING (season)
         WHERE (mkt_defect_code IS NULL OR mkt_defect_code NOT IN ({_IN_EXCLUDED})) AND pack_date <= close GROUP BY 1)
        JOIN (SELECT season, count(*) AS total FROM d_lot JOIN d_bounds USING (season) WHERE PackDate <= close GROUP BY 1)
        USING (season)""",
    "interception_rate_full": f"""SELECT season, with_interceptions, total,
        with_interceptions / CAST(total AS DOUBLE) AS rate FROM
        (SELECT season, count(DISTINCT lot_id) AS with_interceptions FROM d_lot_finding
         WHERE mkt_defect_code IS NULL OR mkt_defect_code NOT IN ({_IN_EXCLUDED}) GROUP BY 1)
        JOIN (SELECT season, count(*) AS total FROM d_lot GROUP BY 1) USING (season)""",
    "pest_counts": "SELECT * FROM d_pest_count",
    "pest_order": f"""SELECT c.*, r.rank FROM d_pest_count c LEFT JOIN (
        SELECT defect, row_number() OVER (ORDER BY defect_qty NULLS LAST, defect) AS rank
        FROM d_pest_count WHERE season = {PRIOR}) r USING (defect)""",
    "size_moments": _rounded(
        "d_moments", 6,
        "mean_eq sd_eq mean_sl sd_sl mean_elong sd_elong mean_mass sd_mass mean_vol sd_vol covar"),
    "yoy_change": """SELECT season, round(value, 8) AS value,
        round(value / lag(value) OVER (PARTITION BY measure ORDER BY season) - 1, 8) AS yoy, measure FROM (
        SELECT season, mean_eq AS value, 'diameter' AS measure FROM d_moments
        UNION ALL SELECT season, mean_mass, 'mass' FROM d_moments)""",
    "density_curve": """SELECT season, x, round(exp(-0.5 * ((x - mean_eq) / sd_eq) ** 2) / (sd_eq * sqrt(2 * pi())), 8)
        AS density, round(mean_eq, 8) AS mean
        FROM (SELECT *, CAST(unnest(generate_series(36, 76)) AS BIGINT) AS x FROM d_moments)""",
    "density_curve_mass": """SELECT season, x,
        round(exp(-0.5 * ((x - mean_mass) / sd_mass) ** 2) / (sd_mass * sqrt(2 * pi())), 8) AS density
        FROM (SELECT *, CAST(unnest(generate_series(0, 4000, 100)) AS BIGINT) AS x FROM d_moments)""",
    "size_band_share": "SELECT * FROM d_band",
    "size_band_pivot": "SELECT * FROM d_band_wide",
    "size_histogram": """SELECT b.bin, count(w.batch_id) AS count FROM (SELECT unnest(range(32)) AS bin) b
        LEFT JOIN d_band_wide w ON b.bin = CAST(least(floor(w."FP" * 32), 31) AS BIGINT) GROUP BY b.bin""",
    "season_kpis": out("SELECT * FROM d_kpi", text="first_harvest last_harvest first_pack"),
    "display_strings": """SELECT season AS "Season", format('{:,}', bins) AS "Bins harvested",
        strftime(first_pack, '%d %B %Y') AS "First pack", printf('%.1f%%', packout * 100) AS "Packout" FROM d_kpi""",
    "display_rounding": """SELECT season, round_even(mean_eq, 1) AS mm,
        printf('%.1f%%', (mean_eq / lag(mean_eq) OVER (ORDER BY season) - 1) * 100) AS yoy_change FROM d_moments""",
    "project_filter": f"""SELECT storage_site, season, CAST(harvest_date AS STRING) AS harvest_date, no_of_bins,
        presize_flag, pick_no, CAST(no_of_bins AS DOUBLE) / 2 AS half_bins FROM d_delivery
        WHERE NOT presize_flag AND harvest_date BETWEEN '1996-01-15' AND '2000-12-20'
        AND (storage_site <> '{SITES[0]}' OR (pick_no = 1 AND no_of_bins > 40))""",
    "in_null": """SELECT CAST(year(START_TIME) AS BIGINT) AS season,
        count(*) FILTER (SIZER_GRADE_NAME NOT IN ('Juice', 'Low Colour')) AS sql_rule,
        count(*) FILTER (coalesce(SIZER_GRADE_NAME, '') NOT IN ('Juice', 'Low Colour')) AS frame_rule,
        count(*) - count(SIZER_GRADE_NAME) AS missing,
        count(*) FILTER (SIZER_GRADE_NAME IN ('Juice', 'Low Colour')) AS listed, count(*) AS total
        FROM STG_COMPAC_BATCH GROUP BY 1""",
    "fact_join": """SELECT grader_batch_id, t.season, packing_site, no_of_bins_tipped,
        CAST(reject_kgs AS DOUBLE) AS reject_kgs FROM d_tipped t LEFT JOIN d_batch USING (grader_batch_id)""",
    "group_sums": """SELECT TemplateID AS template_id,
        CAST(CASE WHEN count(SampleQty) = count(*) THEN sum(SampleQty) END AS BIGINT) AS propagate,
        CAST(coalesce(sum(SampleQty), 0) AS BIGINT) AS skip_zero, CAST(sum(SampleQty) AS BIGINT) AS skip_null,
        count(SampleQty) AS present, count(*) AS n FROM qa_AssessmentT GROUP BY 1""",
    "group_forms": """SELECT CAST(SampleFlag AS STRING) AS key, CAST(sum(NoOfUnits * NetFruitWeight) AS DOUBLE) AS kgs,
        CAST(NULL AS BIGINT) AS units, CAST(NULL AS STRING) AS first, CAST(NULL AS STRING) AS last,
        CAST(NULL AS STRING) AS text FROM ma_Pallet_DetailT JOIN sw_ProductT USING (ProductID) GROUP BY 1
        UNION ALL SELECT 'all', NULL, CAST(sum(NoOfUnits) AS BIGINT), NULL, NULL, NULL
        FROM ma_Pallet_DetailT JOIN sw_ProductT USING (ProductID)
        UNION ALL SELECT 'dates', NULL, NULL, CAST(min(harvest_date) AS STRING), CAST(max(pack_date) AS STRING),
        max(farm_name) FROM d_batch""",
    "group_seven_keys": out(
        """SELECT season, pack_site, production_site, maturity_code, storage_type, pick_no, pack_date,
        count(input_kgs) AS n, sum(input_kgs) AS input_kgs FROM d_batch GROUP BY 1, 2, 3, 4, 5, 6, 7""",
        text="pack_date", real="input_kgs"),
    "sort_nulls_topn": """SELECT AssessmentID AS assessment_id, SampleQty AS sample_qty FROM qa_AssessmentT
        ORDER BY SampleQty NULLS LAST, AssessmentID LIMIT 15""",
    "keyed_pick": f"SELECT season, share FROM d_pick WHERE pick_no = 1 AND season IN ({PRIOR}, {CURRENT})",
    "row_bind": """SELECT a.season, a.bins AS harvested, b.season AS tipped_season, b.bins AS tipped
        FROM (SELECT *, row_number() OVER (ORDER BY season) AS r FROM d_harvest_total) a
        JOIN (SELECT *, row_number() OVER (ORDER BY season) AS r FROM d_tipped_total) b USING (r)""",
    "row_bind_rows": out("""SELECT a.harvest_date, bin_delivery_id, no_of_bins, pack_date, grader_batch_id, input_kgs
        FROM (SELECT *, row_number() OVER (ORDER BY harvest_date, bin_delivery_id, no_of_bins) AS r FROM d_delivery) a
        JOIN (SELECT *, row_number() OVER (ORDER BY pack_date, grader_batch_id) AS r FROM d_batch) b USING (r)""",
        text="harvest_date pack_date", real="input_kgs"),
    "running_rows": out("""SELECT season, pack_date, grader_batch_id, input_kgs, reject_kgs,
        CASE WHEN count(*) OVER w = count(input_kgs) OVER w THEN sum(input_kgs) OVER w END AS running_kgs,
        CASE WHEN count(*) OVER v = count(reject_kgs) OVER v THEN sum(reject_kgs) OVER v END AS running_reject
        FROM d_batch WINDOW w AS (PARTITION BY season, pack_site ORDER BY pack_date, grader_batch_id),
        v AS (PARTITION BY season ORDER BY pack_date, grader_batch_id)""",
        text="pack_date", real="input_kgs reject_kgs running_kgs running_reject"),
    "null_spread_join": """SELECT assessment_id, a.grader_batch_id, sample_qty FROM (
          SELECT assessment_id, CASE WHEN assessment_id % 2 = 0 THEN grader_batch_id END AS grader_batch_id FROM d_assessment) a
        LEFT JOIN d_sample_qty s ON s.grader_batch_id IS NOT DISTINCT FROM a.grader_batch_id""",
    "size_moments_merged": _rounded(
        "d_moments", 6,
        "mean_eq sd_eq mean_sl sd_sl mean_elong sd_elong mean_mass sd_mass mean_vol sd_vol covar"),
    "size_histogram_default": """WITH v AS (SELECT 'minor' AS measure, 30 AS bins, minor AS v FROM d_fruit UNION ALL SELECT 'Tube', 12, "Tube" FROM d_band_wide),
        e AS (SELECT measure, bins, min(v) - (max(v) - min(v)) / (bins - 1) / 2 AS low, (max(v) - min(v)) / (bins - 1) AS w FROM v GROUP BY measure, bins),
        b AS (SELECT *, unnest(range(bins)) AS bin FROM e)
        SELECT bin, round(low + bin * w, 8) AS low, round(low + (bin + 1) * w, 8) AS high, count(v.v) AS count, b.measure
        FROM b LEFT JOIN v ON v.measure = b.measure AND ceil((v.v - low) / w - 1e-8) - 1 = bin GROUP BY b.measure, bin, low, w""",
    "footer_extents": """SELECT season, count(*) AS n, CAST(min(harvest_date) AS STRING) AS least_harvest_date,
        CAST(max(harvest_date) AS STRING) AS most_harvest_date, CAST(min(pack_date) AS STRING) AS least_pack_date,
        CAST(max(pack_date) AS STRING) AS most_pack_date, min(grader_batch_id) AS least_grader_batch_id,
        max(grader_batch_id) AS most_grader_batch_id FROM d_batch GROUP BY season""",
    "dataset_rerun": f"""SELECT grader_batch_id, season, pack_site, CASE WHEN season IN ({PRIOR}, {CURRENT}) THEN 1 ELSE CAST(input_kgs AS DOUBLE) END AS input_kgs
        FROM d_batch WHERE season <> {PRIOR - 1} AND (season NOT IN ({PRIOR}, {CURRENT}) OR pack_site = '{SITE}')""",
    "report_runs": f"""SELECT season, format('{{:,}}', bins) AS bins, 'table' AS part FROM d_harvest_total WHERE season > {SEASONS[0] + 1}
        UNION ALL SELECT season, CAST(bins AS STRING), 'figure' FROM d_harvest_total""",
    "season_to_date_landed": out(f"""SELECT grader_batch_id, season, pack_date, input_kgs FROM d_site_batch JOIN d_bounds USING (season)
        WHERE season IN ({PRIOR}, {CURRENT}) AND pack_date >= first_pack AND pack_date < close""", text="pack_date", real="input_kgs"),
    "union_by_name": f"""SELECT CASE WHEN season >= {PRIOR} THEN 'current' ELSE 'archive' END AS source_db, season,
        CASE WHEN season >= {PRIOR} THEN pick_no END AS pick_no, CAST(sum(no_of_bins) AS BIGINT) AS bins
        FROM d_delivery GROUP BY 1, 2, 3""",
    "closed_bin_cte": """SELECT BinDeliveryID AS bin_delivery_id, ClosedDateTime IS NOT NULL AS closed,
        CAST(sum(BinQty) AS BIGINT) AS bin_qty FROM ma_Bin_UsageT JOIN ma_Grader_BatchT USING (GraderBatchID)
        GROUP BY 1, 2""",
    "season_label": f"""SELECT CAST(CASE WHEN year(START_TIME) BETWEEN {SEASONS[2]} AND {SEASONS[-2]}
        THEN year(START_TIME) ELSE 1900 END AS BIGINT) AS season, count(*) AS n FROM STG_COMPAC_BATCH GROUP BY 1""",
    "date_parts": out(
        f"""SELECT grader_batch_id, CAST(week(pack_date) AS BIGINT) AS iso_week, pack_date - harvest_date AS storage_days,
        harvest_date + 7 AS week_later, make_date(2024, month(harvest_date), day(harvest_date)) AS plot_date,
        {close_date('season')} AS close, CAST(substr(farm_code, 2) AS BIGINT) AS farm_number, pack_date AS pack_day
        FROM d_batch""", text="week_later plot_date close pack_day"),
    "many_columns": "SELECT season, row_number() OVER (ORDER BY total, season) AS rank, " + ", ".join(
        f'"{s}" / CAST(total AS DOUBLE) AS "share_{s}"' for s in SITES) + " FROM d_site_shares",
    "pushed_scan": """SELECT GROWER_CODE AS grower_code, count(*) AS n, min(MINOR) AS least, max(MINOR) AS most
        FROM STG_COMPAC_BATCH WHERE START_TIME >= TIMESTAMP '1999-06-01' AND START_TIME < TIMESTAMP '2000-06-01'
        GROUP BY 1""",
}

# The same rows by another layout or way of writing.
ORACLES |= {
    "bins_tipped_bucketed": ORACLES["bins_tipped"], "batch_detail_bucketed": ORACLES["batch_detail"],
    "bins_for_batch_bucketed": ORACLES["bins_for_batch"],
    "csv_round_trip": f"SELECT * RENAME (bins AS no_of_bins) FROM ({ORACLES['cumulative_harvest']})",
}


def statement(select: str) -> str:
    """The SELECT with the subqueries it needs, in dependency order."""
    definitions = {name: view.sql() for name, view in VIEWS.items()} | DATASETS
    names = re.compile(r"\b(" + "|".join(map(re.escape, definitions)) + r")\b")
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(names.findall(text)):
            if name not in ordered:
                need(definitions[name])
                if name not in ordered:
                    ordered.append(name)

    need(select)
    head = ",\n".join(f"{n} AS ({definitions[n]})" for n in ordered)
    return f"WITH {head}\nSELECT * FROM (\n{select}\n)"


def oracle_statements() -> dict[str, str]:
    return {key: statement(sql) for key, sql in ORACLES.items()}
