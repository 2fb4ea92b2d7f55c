-- Batches with grower, site and weights, once per sample line. :juice_product is the product id of juice fruit.
WITH juice AS (
  SELECT PresizeOutputFromGraderBatchID AS GraderBatchID, sum(TotalWeight) AS kgs
  FROM {ma_Bin_DeliveryT}
  WHERE PresizeProductID = :juice_product
  GROUP BY ALL
), tipped AS (
  SELECT GraderBatchID, count(BinID) AS bins FROM {ma_BinT} WHERE GraderBatchID IS NOT NULL GROUP BY ALL
), samples AS (
  SELECT l.GraderBatchID, CAST(l.NoOfUnits * p.NetFruitWeight AS DECIMAL(18, 4)) AS kgs
  FROM {ma_Pallet_DetailT} l JOIN {sw_ProductT} p USING (ProductID)
  WHERE p.SampleFlag
)
SELECT b.GraderBatchID AS grader_batch_id, b.GraderBatchNo AS grader_batch, try_cast(n.SeasonDesc AS INT) AS season,
       g.CompanyName AS grower, f.FarmCode AS rpin, f.FarmName AS orchard, s.SubdivisionCode AS production_site,
       b.HarvestDate AS harvest_date, b.PackDate AS pack_date, k.CompanyName AS pack_site, t.bins AS bins_tipped,
       b.InputKgs AS input_kgs,
       CAST(b.WasteOtherKgs + coalesce(j.kgs, 0) + coalesce(x.kgs, 0) AS DECIMAL(18, 4)) AS reject_kgs,
       if(b.ClosedDateTime IS NULL, 0, 1) AS batch_closed
FROM {ma_Grader_BatchT} b
JOIN {sw_SeasonT} n USING (SeasonID)
JOIN {sw_FarmT} f ON f.FarmID = b.FarmID
JOIN {sw_SubdivisionT} s ON s.SubdivisionID = b.SubdivisionID
JOIN {sw_MaturityT} m ON m.MaturityID = b.MaturityID
JOIN {sw_Pick_NoT} p ON p.PickNoID = b.PickNoID
JOIN {sw_CompanyT} k ON k.CompanyID = b.PackingCompanyID
JOIN {sw_CompanyT} g ON g.CompanyID = f.GrowerCompanyID
LEFT JOIN juice j ON j.GraderBatchID = b.GraderBatchID
LEFT JOIN tipped t ON t.GraderBatchID = b.GraderBatchID
LEFT JOIN samples x ON x.GraderBatchID = b.GraderBatchID
