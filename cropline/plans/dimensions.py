"""Dimension lookups under the names a role gives them.

No lookup carries a broadcast hint. Spark broadcasts one while its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and falls back to a (skew-splitting) sort-merge join when a
dimension, such as farms or blocks, outgrows it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropline.functions.scalars import to_int
from cropline.operators.relational import pick

Tables = Mapping[str, DataFrame]


def seasons(t: Tables) -> DataFrame:
    """Season text becomes an integer here, once for the whole library."""
    return t["sw_SeasonT"].select(F.col("SeasonID").alias("season_id"), to_int("SeasonDesc").alias("season"))


def companies(t: Tables, key: str, name: str) -> DataFrame:
    """The company table in one role, such as packer, grower or storage site."""
    return pick(t["sw_CompanyT"], **{key: "CompanyID", name: "CompanyName"})


def farms(t: Tables) -> DataFrame:
    return pick(
        t["sw_FarmT"], farm_id="FarmID", farm_code="FarmCode", farm_name="FarmName",
        farm_grower_id="GrowerCompanyID",
    )


def blocks(t: Tables) -> DataFrame:
    return pick(t["sw_Farm_BlockT"], block_id="BlockID", block_code="BlockCode", subdivision_id="SubdivisionID")


def subdivisions(t: Tables) -> DataFrame:
    return pick(t["sw_SubdivisionT"], subdivision_id="SubdivisionID", production_site="SubdivisionCode")


def maturities(t: Tables) -> DataFrame:
    return pick(t["sw_MaturityT"], maturity_id="MaturityID", maturity_code="MaturityCode")


def picks(t: Tables, column: str = "PickNoDesc") -> DataFrame:
    return pick(t["sw_Pick_NoT"], pick_no_id="PickNoID", pick_no=column)


def storage_types(t: Tables) -> DataFrame:
    return pick(t["sw_Storage_TypeT"], storage_type_id="StorageTypeID", storage_type="StorageTypeDesc")
