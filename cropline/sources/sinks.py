"""Writers for report tables, chart data and CSV extracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cropline.functions.scalars import percent_text, round_half_even, thousands_text


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV part files with a header each."""
    df.write.mode(mode).option("header", True).csv(path)


def write_report_table(
    df: DataFrame,
    path: str,
    order_by: Sequence[str | Column] = (),
    rename: Mapping[str, str] | None = None,
    fmt: str = "parquet",
    mode: str = "errorifexists",
) -> None:
    """Rows of one table or figure, in reading order, under display names.

    ``orderBy`` sorts by ranges, so a row-level figure is written by many tasks as ordered part files.
    """
    if order_by:
        df = df.orderBy(*order_by)
    if rename:
        df = df.withColumnsRenamed(dict(rename))
    writer = df.write.mode(mode).format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def write_dataset(df: DataFrame, path: str, by: str = "season", mode: str = "errorifexists") -> None:
    """A named dataset as parquet partitioned by season, so that later season filters skip whole folders."""
    df.write.mode(mode).partitionBy(by).parquet(path)


def replace_partitions(
    df: DataFrame, path: str, by: Sequence[str], fmt: str = "parquet", covers: DataFrame | None = None,
    order_by: Sequence[str] = (),
) -> None:
    """Write a frame partitioned by ``by``; of what is there only the partitions that it has rows for are replaced.

    Files are written aside and moved when all tasks are done, so a run that fails leaves the rows as they were, and a run
    that is repeated gives the same rows. ``covers`` (the columns ``by``) lists partitions that the run speaks for: those of
    them without a row are emptied afterwards.
    """
    ordered = df.orderBy(*by, *order_by) if order_by else df
    writer = ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
    if covers is None:
        return
    spark = df.sparkSession
    there = spark.read.format(fmt).option("header", True).load(path).select(*by).distinct()
    same = reduce(and_, [F.col(f"c.`{c}`").cast("string").eqNullSafe(F.col(f"t.`{c}`").cast("string")) for c in by])
    had = df.select(*by).distinct()
    own = reduce(and_, [F.col(f"c.`{c}`").cast("string").eqNullSafe(F.col(f"h.`{c}`").cast("string")) for c in by])
    gone = covers.alias("c").join(there.alias("t"), same, "left_semi").join(had.alias("h"), own, "left_anti")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for row in gone.select(*[F.col(f"c.`{c}`").cast("string") for c in by]).distinct().collect():  # folders, not rows
        folder = hadoop("/".join([path.rstrip("/"), *(f"{c}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for c, v in zip(by, row))]))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@dataclass(frozen=True)
class Display:
    """How a report table is shown: its columns in order under their names, and which are percent, thousands or rounded.

    ``columns`` maps column to shown name; without it all columns stay. ``percent`` and ``rounded`` give digits.
    """

    columns: Mapping[str, str] | None = None
    order_by: Sequence[str] = ()
    percent: Mapping[str, int] = field(default_factory=dict)
    thousands: Sequence[str] = ()
    rounded: Mapping[str, int] = field(default_factory=dict)

    def show(self, df: DataFrame) -> DataFrame:
        texts = {c: percent_text(c, digits) for c, digits in self.percent.items()}
        texts |= {c: thousands_text(f"`{c}`") for c in self.thousands}
        texts |= {c: round_half_even(c, digits) for c, digits in self.rounded.items()}
        names = self.columns or {c: c for c in df.columns}
        return df.select(*[texts.get(c, F.col(f"`{c}`")).alias(name) for c, name in names.items()])


def write_chart_data(
    figures: Mapping[str, DataFrame], root: str, fmt: str = "parquet", displays: Mapping[str, Display] | None = None
) -> None:
    """One folder per figure under ``root``, each in its order, and in its display form where ``displays`` has one."""
    for name, df in figures.items():
        display = (displays or {}).get(name, Display())
        if display.order_by:
            df = df.orderBy(*[F.col(c) for c in display.order_by])
        write_report_table(display.show(df), f"{root.rstrip('/')}/{name}", fmt=fmt)


def write_run(
    figures: Mapping[str, DataFrame], root: str, run: str, fmt: str = "parquet", displays: Mapping[str, Display] | None = None
) -> None:
    """The figures of one report run, each in its folder under ``root`` and there under ``run``, in their display forms.

    A run that is repeated replaces itself; other runs stay.
    """
    for name, df in figures.items():
        display = (displays or {}).get(name, Display())
        placed = df.orderBy(*[F.col(c) for c in display.order_by]) if display.order_by else df
        shown = display.show(placed).withColumns({"run": F.lit(run), "row": F.monotonically_increasing_id()})
        replace_partitions(shown, f"{root.rstrip('/')}/{name}", ["run"], fmt, order_by=["row"] if display.order_by else ())


def read_run(spark: SparkSession, path: str, run: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A figure as ``run`` wrote it, or as the newest run did, which the folder names tell without reading a row."""
    rows = spark.read.format(fmt).option("header", True).load(path)
    runs = rows.select(F.col("run").cast("string").alias("run")).distinct()
    chosen = F.lit(run) if run is not None else runs.agg(F.max("run")).scalar()
    return rows.filter(F.col("run").cast("string") == chosen).drop("run").orderBy(F.col("row").cast("bigint")).drop("row")
