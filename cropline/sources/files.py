"""CSV extracts and SQL files."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SQL_DIR = Path(__file__).resolve().parent.parent / "sql"

HARVEST_CURVE = "Season int, HarvestDate date, NoOfBins bigint, cumBins bigint, PlotDate date"


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header row and a declared schema. A malformed line fails the job instead of becoming nulls."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def run_sql_file(
    spark: SparkSession, path: str | Path, tables: Mapping[str, DataFrame] | None = None, **args: Any
) -> DataFrame:
    """Run the SELECT in a .sql file. ``:name`` markers take their value from ``args``.

    ``{table}`` stands for one of ``tables``, which Spark names for this query alone; other names are looked up in the
    session. Comments and line breaks stay as they are.
    """
    text = Path(path).read_text(encoding="utf-8").strip().rstrip(";")
    used = {name: df for name, df in (tables or {}).items() if "{" + name + "}" in text}
    return spark.sql(text, args=args or None, **used)
