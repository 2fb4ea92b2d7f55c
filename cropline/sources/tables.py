"""Source tables from files: lazy frames whose filters and columns Catalyst pushes into the scan."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cropline.schema import TABLES, schema_of

def read_tables(
    spark: SparkSession, root: str, names: Iterable[str] = TABLES, fmt: str = "parquet"
) -> dict[str, DataFrame]:
    """``{table: frame}`` from ``root/<table>``, with the declared schema (no inference pass)."""
    return {n: spark.read.schema(schema_of(n)).format(fmt).load(f"{root.rstrip('/')}/{n}") for n in names}


def conform(df: DataFrame, table: str) -> DataFrame:
    """The declared columns of a source table in their declared types, such as a date kept as a timestamp."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema_of(table)])


def land(df: DataFrame, path: str, by: str | None = None, mode: str = "errorifexists") -> DataFrame:
    """Write a frame as parquet to a folder that all executors share, and read it back.

    Later plans see its real size, and filters on ``by`` skip whole folders. Nothing depends on the executors that
    computed it.
    """
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])


def land_tables(tables: Mapping[str, DataFrame], root: str, by: str = "SeasonID", mode: str = "errorifexists") -> dict[str, DataFrame]:
    """Land source tables under ``root``, partitioned by season where they have one and are no dimension.

    A database table has no size estimate, so Spark would shuffle a fact on a dimension's few keys; the landed
    dimension is broadcast by its measured size.
    """
    return {
        n: land(df, f"{root.rstrip('/')}/{n}", by if by in df.columns and not n.startswith("sw_") else None, mode)
        for n, df in tables.items()
    }


def read_for_footers(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Parquet files as a scan that answers counts, minima and maxima by partition column from the files' footers.

    The setting that chooses this scan is only read while the frame is made, and is put back; the push itself is on in
    ``session.SETTINGS``.
    """
    key = "spark.sql.sources.useV1SourceList"
    before = spark.conf.get(key)
    spark.conf.set(key, ",".join(s for s in before.split(",") if s != "parquet"))
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    finally:
        spark.conf.set(key, before)


def footer_extent(df: DataFrame, by: str, columns: Iterable[str]) -> DataFrame:
    """``by``, the number of rows, and least_<c> and most_<c> of each column.

    Over a frame of ``read_for_footers`` that is partitioned by ``by``, and columns of whole numbers, dates or booleans,
    nothing but footers is read.
    """
    ends = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("least", F.min), ("most", F.max))]
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *ends)
