"""Tables kept in buckets of one key, so that reports join and count by it again and again without a shuffle.

Rows of a key that is too frequent for one task, and rows without a key, are kept apart in plain files. A plan whose rows
come from one key each gives the same rows over both parts, one after the other: ``over_parts``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropline.sources.tables import land

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class BucketedTables:
    """``even`` has the bucketed tables, ``frequent`` the rows of frequent and missing keys; both have all other tables."""

    even: Tables
    frequent: Tables


def frequent_keys(tables: Tables, keys: Mapping[str, str], hot_rows: int) -> DataFrame:
    """``key``: those with more than ``hot_rows`` rows in one of the tables, so at most one for each ``hot_rows`` rows."""
    out = None
    for name, key in keys.items():
        counted = tables[name].filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        found = counted.filter(F.col("n") > hot_rows).select("key")
        out = found if out is None else out.union(found)
    return out.distinct()


def attach(spark: SparkSession, table: str, schema: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """A bucketed table over files that an earlier session landed."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
              f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def land_bucketed(
    tables: Tables, keys: Mapping[str, str], root: str, prefix: str, buckets: int, hot_rows: int
) -> BucketedTables:
    """Land the tables named in ``keys`` (table to key column) in ``buckets`` below ``root``, as tables ``prefix_<table>``.

    ``buckets`` follows the size of the largest table (about 128 MB in each); all have the same number, or a join would
    shuffle one of them. A bucket is one file, in order of the key.
    """
    root = root.rstrip("/")
    if not keys:
        return BucketedTables(tables, tables)
    hot = land(frequent_keys(tables, keys, hot_rows), f"{root}/frequent_keys")
    even, frequent = dict(tables), dict(tables)
    for name, key in keys.items():
        df = tables[name]
        known = df.filter(F.col(key).isNotNull()).join(hot, F.col(key) == F.col("key"), "left_anti")
        table, path = f"{prefix}_{name}", f"{root}/even/{name}"
        known.repartition(buckets, F.col(key)).write.bucketBy(buckets, key).sortBy(key).option("path", path).format(
            "parquet").saveAsTable(table)
        even[name] = df.sparkSession.table(table)
        rest = df.join(hot, F.col(key) == F.col("key"), "left_semi").unionByName(df.filter(F.col(key).isNull()))
        frequent[name] = land(rest, f"{root}/frequent/{name}")
    return BucketedTables(even, frequent)


def over_parts(landed: BucketedTables, plan: Callable[[Tables], DataFrame]) -> DataFrame:
    """``plan`` over all rows, for plans of which every row comes from the rows of one key.

    The even part needs no shuffle by the key; in the other one adaptive execution splits what a frequent key joins.
    """
    return plan(landed.even).unionByName(plan(landed.frequent))
