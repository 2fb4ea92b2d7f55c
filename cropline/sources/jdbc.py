"""Source tables from a database.

``read_jdbc`` reads a table or query with filters and columns pushed into the remote SELECT, split over
tasks if a split is given. ``attach_warehouse`` adds the database as a catalog; tables read through it
also have aggregates, limits and top-n pushed down, so only the aggregated rows cross the network.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from cropline.sources.tables import conform


@dataclass(frozen=True)
class JdbcDatabase:
    """Where a database is and how to log in. Credentials are given by the caller, never stored in code."""

    url: str
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    driver: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def from_env(cls, prefix: str, env: Mapping[str, str] | None = None) -> JdbcDatabase:
        """Read ``<prefix>_URL``, ``_USER``, ``_PASSWORD`` and ``_DRIVER``."""
        env = os.environ if env is None else env
        return cls(
            env[f"{prefix}_URL"], env.get(f"{prefix}_USER"), env.get(f"{prefix}_PASSWORD"), env.get(f"{prefix}_DRIVER")
        )


@dataclass(frozen=True)
class Split:
    """Parallel read on a numeric, date or timestamp column. Without it a table is read by one task."""

    column: str
    lower: str | int
    upper: str | int
    partitions: int


def read_options(
    db: JdbcDatabase, table: str | None = None, query: str | None = None, split: Split | None = None
) -> dict[str, str]:
    if (table is None) == (query is None):
        raise ValueError("give exactly one of table and query")
    opts = {"url": db.url, "fetchsize": "10000", "preferTimestampNTZ": "true", **db.options}
    if query is not None and split is not None:
        opts["dbtable"] = f"({query}) q"  # a split read needs a relation, not a bare query
    elif query is not None:
        opts["query"] = query
    else:
        opts["dbtable"] = table
    for key in ("user", "password", "driver"):
        if getattr(db, key) is not None:
            opts[key] = getattr(db, key)
    if split is not None:
        opts |= {
            "partitionColumn": split.column,
            "lowerBound": str(split.lower),
            "upperBound": str(split.upper),
            "numPartitions": str(split.partitions),
        }
    return opts


def read_jdbc(
    spark: SparkSession,
    db: JdbcDatabase,
    table: str | None = None,
    query: str | None = None,
    split: Split | None = None,
) -> DataFrame:
    """A table or a SELECT of the database as a lazy frame."""
    return spark.read.format("jdbc").options(**read_options(db, table, query, split)).load()


def read_jdbc_tables(
    spark: SparkSession, db: JdbcDatabase, names: Iterable[str], splits: Mapping[str, Split] | None = None
) -> dict[str, DataFrame]:
    """``{table: frame}`` for the dataset functions, in declared types. Give the fact tables a split."""
    splits = splits or {}
    return {n: conform(read_jdbc(spark, db, table=n, split=splits.get(n)), n) for n in names}


CATALOG_CLASS = "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog"


def catalog_settings(name: str, db: JdbcDatabase) -> dict[str, str]:
    prefix = f"spark.sql.catalog.{name}"
    settings = {
        prefix: CATALOG_CLASS,
        f"{prefix}.url": db.url,
        f"{prefix}.pushDownAggregate": "true",
        f"{prefix}.pushDownLimit": "true",
    }
    for key in ("user", "password", "driver"):
        if getattr(db, key) is not None:
            settings[f"{prefix}.{key}"] = getattr(db, key)
    return settings | {f"{prefix}.{k}": v for k, v in db.options.items()}


def attach_warehouse(spark: SparkSession, name: str, db: JdbcDatabase) -> None:
    """Make the database's tables available as ``spark.table("<name>.<schema>.<table>")``."""
    for key, value in catalog_settings(name, db).items():
        spark.conf.set(key, value)
