-- Existing cartons by season and lot.
SELECT try_cast(s.SeasonDesc AS INT) AS season, c.GraderBatchMPILotID AS lot_id, count(c.CartonNo) AS cartons
FROM {ma_CartonT} c JOIN {sw_SeasonT} s USING (SeasonID)
WHERE c.CartonExistsFlag
GROUP BY ALL
