-- Tipped bins per batch and delivery of one season, given as :season.
SELECT b.GraderBatchID AS `Grader batch`, n.BinDeliveryID AS `Bin delivery`, count(n.BinID) AS `Bins tipped`
FROM {ma_BinT} n
JOIN {ma_Grader_BatchT} b USING (GraderBatchID)
JOIN {sw_SeasonT} s USING (SeasonID)
WHERE s.SeasonDesc = :season
GROUP BY ALL
