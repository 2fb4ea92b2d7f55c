-- Bins used per delivery, split by whether the batch is closed.
SELECT u.BinDeliveryID AS bin_delivery_id,
       if(b.ClosedDateTime IS NULL, 0, 1) AS bins_tipped,
       sum(u.BinQty) AS bin_qty
FROM {ma_Bin_UsageT} u JOIN {ma_Grader_BatchT} b USING (GraderBatchID)
GROUP BY ALL
