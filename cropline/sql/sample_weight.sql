-- Sample and juice weight by batch. :juice_product is the product id of juice fruit.
WITH kgs AS (
  SELECT GraderBatchID, 0 AS juice, l.NoOfUnits * p.NetFruitWeight AS sample
  FROM {ma_Pallet_DetailT} l JOIN {sw_ProductT} p USING (ProductID)
  WHERE p.SampleFlag
  UNION ALL
  SELECT PresizeOutputFromGraderBatchID, TotalWeight, 0
  FROM {ma_Bin_DeliveryT}
  WHERE PresizeProductID = :juice_product
)
SELECT GraderBatchID AS grader_batch_id, sum(juice) AS juice_kgs, sum(sample) AS sample_kgs
FROM kgs
GROUP BY GraderBatchID
