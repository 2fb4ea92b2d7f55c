"""The registered queries: the library's datasets and operators over the source tables.

Outputs are put in plain types (bigint, double, string, boolean) so that two engines can be compared.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropline.functions import aggregates as agg
from cropline.functions import scalars as sc
from cropline.operators import bounds as bnd
from cropline.operators import defects as dfc
from cropline.operators import harvest as hv
from cropline.operators import ordered
from cropline.operators import packout as po
from cropline.operators import phyto as ph
from cropline.operators import relational as rel
from cropline.operators import size as sz
from cropline.plans import fruit_data, harvest_data, packing_data, phyto_data, quality_data
from cropline.plans.season_report import season_kpis as season_table
from cropline.session import configure, work_folder
from cropline.sources import files, sinks
from cropline.sources.buckets import BucketedTables, land_bucketed, over_parts
from cropline.sources.sinks import replace_partitions, write_dataset
from cropline.sources.tables import footer_extent, land, read_for_footers
from cropline_check.views import CURRENT, EXCLUDED, MONTH_DAY, PRIOR, SEASONS, SITE, SITES, source_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


class Context:
    """Source tables and the frames that several queries start from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        configure(spark)
        self.spark = spark
        self.t = source_tables(spark, str(sf_dir))

    @cached_property
    def deliveries(self) -> DataFrame:
        return harvest_data.bins_harvested_pick(self.t)

    @cached_property
    def tipped(self) -> DataFrame:
        return packing_data.bins_tipped(self.t)

    @cached_property
    def batches(self) -> DataFrame:
        return packing_data.grader_batch_detail(self.t)

    @cached_property
    def site_batches(self) -> DataFrame:
        return po.packout_by_batch(self.batches, SITE)

    @cached_property
    def closed_batches(self) -> DataFrame:
        return po.packout_by_batch(packing_data.grader_batch(self.t), SITE, closed_only=True)

    @cached_property
    def regression(self) -> DataFrame:
        return po.packout_regression(self.closed_batches, cap_season=CURRENT)

    @cached_property
    def bounds(self) -> DataFrame:
        """One row per season, landed once: several parts of a figure read it."""
        return bnd.land_bounds(bnd.season_bounds(self.batches, SITE, month_day=MONTH_DAY), work_folder(self.spark, "bounds"))

    @cached_property
    def assessments(self) -> DataFrame:
        return quality_data.defect_assessments(self.t)

    @cached_property
    def proportions(self) -> DataFrame:
        samples = dfc.sample_qty_by_batch(self.assessments, self.bounds)
        return dfc.batch_defect_proportion(quality_data.defects(self.t), self.assessments, samples, self.batches)

    @cached_property
    def profile(self) -> DataFrame:
        return dfc.defect_profile(self.proportions, self.bounds)

    @cached_property
    def by_batch(self) -> BucketedTables:
        """Bins, lines and batches in buckets of the batch; batches of more than 7 rows are kept apart here."""
        keys = {name: "GraderBatchID" for name in ("ma_BinT", "ma_Pallet_DetailT", "ma_Grader_BatchT")}
        root = work_folder(self.spark, "by_batch")
        return land_bucketed(self.t, keys, root, f"t{root.rpartition('-')[2]}", buckets=8, hot_rows=7)

    @cached_property
    def findings(self) -> DataFrame:
        return phyto_data.phyto_assessments(self.t)

    @cached_property
    def lot_summary(self) -> DataFrame:
        return ph.phyto_lot_summary(self.findings, phyto_data.mpi_lot_detail(self.t))

    @cached_property
    def lot_findings(self) -> DataFrame:
        return phyto_data.findings_with_requirements(self.t, self.lot_summary)

    @cached_property
    def pests(self) -> DataFrame:
        return ph.pest_counts(self.findings, phyto_data.lot_ids(self.t), self.bounds)

    @cached_property
    def fruit(self) -> DataFrame:
        return fruit_data.fruit_measurements(self.t, SEASONS[1:], MONTH_DAY, other_season=SEASONS[0])

    @cached_property
    def moments(self) -> DataFrame:
        return sz.size_moments(self.fruit)

    @cached_property
    def bands(self) -> DataFrame:
        return sz.size_band_share(fruit_data.fruit_measurements(self.t, [PRIOR]))


def plain(df: DataFrame) -> DataFrame:
    """Integers as bigint, decimals as double, dates and timestamps as text."""

    def cast(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(field.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        return c.alias(field.name)

    return df.select(*[cast(f) for f in df.schema.fields])


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Figures that depend on summation order, rounded far beyond display precision."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def finite(df: DataFrame, column: str) -> DataFrame:
    """Split a floating value into its finite part and a text state."""
    c = F.col(column)
    state = (
        F.when(c.isNull(), "missing").when(F.isnan(c), "nan").when(sc.is_finite(c), "finite").otherwise("infinite")
    )
    return df.withColumns({f"{column}_state": state, column: F.when(sc.is_finite(c), c)})


def query(build: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: plain(build(Context(spark, sf_dir)))
    return build


# --- datasets -------------------------------------------------------------------------------

@query
def bins_harvested(x):
    return harvest_data.bins_harvested(x.t)


@query
def bins_harvested_pick(x):
    return x.deliveries


@query
def bins_tipped(x):
    return x.tipped


@query
def batch_detail(x):
    return x.batches


@query
def batch_detail_fanout(x):
    return packing_data.grader_batch(x.t)


@query
def batch_one_row(x):
    return packing_data.grader_batch(x.t, aggregate_samples=True)


@query
def batch_by_block(x):
    return packing_data.grader_batch_by_block(x.t)


@query
def sql_grader_batch(x):
    return files.run_sql_file(x.spark, files.SQL_DIR / "grader_batch.sql", x.t, juice_product=packing_data.JUICE_PRODUCT)


@query
def sql_grader_batch_by_block(x):
    path = files.SQL_DIR / "grader_batch_by_block.sql"
    return files.run_sql_file(x.spark, path, x.t, juice_product=packing_data.JUICE_PRODUCT)


@query
def batch_dates(x):
    return packing_data.grader_batch_dates(x.t)


@query
def juice_kgs(x):
    return packing_data.juice_kgs(x.t)


@query
def sample_kgs(x):
    return packing_data.sample_kgs(x.t)


@query
def bin_delivery(x):
    return harvest_data.bin_delivery(x.t)


@query
def bin_usage(x):
    return harvest_data.bin_usage(x.t)


@query
def bins_tipped_bucketed(x):
    """``bins_tipped`` over tables in buckets of the batch, of which frequent batches are kept apart."""
    return over_parts(x.by_batch, packing_data.bins_tipped)


@query
def batch_detail_bucketed(x):
    return over_parts(x.by_batch, packing_data.grader_batch_detail)


@query
def bins_for_batch_bucketed(x):
    return over_parts(x.by_batch, harvest_data.bins_for_grader_batch)


@query
def bins_for_batch(x):
    return harvest_data.bins_for_grader_batch(x.t)


@query
def transfers(x):
    return harvest_data.transfers(x.t)


@query
def defect_assessments(x):
    return x.assessments


@query
def defects(x):
    return quality_data.defects(x.t)


@query
def defect_assessment_summary(x):
    return quality_data.defect_assessment_summary(x.t)


@query
def market_rules(x):
    return phyto_data.market_pest_rules(x.t)


@query
def phyto_findings(x):
    return x.findings


@query
def phyto_findings_once(x):
    return phyto_data.phyto_assessments(x.t, dedupe=True)


@query
def phyto_findings_all(x):
    return phyto_data.phyto_assessments_all(x.t)


@query
def lot_detail(x):
    return phyto_data.mpi_lot_detail(x.t)


@query
def lot_detail_older(x):
    return phyto_data.mpi_lot_detail(x.t, with_site=False)


@query
def lot_sites(x):
    return phyto_data.mpi_lot_sites(x.t)


@query
def lot_dates(x):
    return phyto_data.mpi_lots(x.t)


@query
def lot_requirements(x):
    return phyto_data.lot_pip_requirements(x.t)


@query
def cartons_by_lot(x):
    return phyto_data.cartons_by_lot(x.t)


@query
def fruit_measurements(x):
    return rounded(x.fruit, 8, "elongation")


# --- season bounds ---------------------------------------------------------------------------

@query
def season_bounds(x):
    return bnd.season_bounds(x.batches, SITE, month_day=MONTH_DAY)


@query
def season_bounds_week(x):
    return bnd.season_bounds(x.batches, SITE, days=7)


@query
def season_bounds_prior_db(x):
    older = packing_data.grader_batch_dates(x.t)
    return bnd.season_bounds(older, month_day=MONTH_DAY, seasons=[PRIOR - 2, PRIOR - 1])


@query
def season_to_date(x):
    rows = bnd.season_to_date(x.site_batches, x.bounds, "pack_date", lower="first_pack", upper="lt")
    return rows.select("grader_batch_id", "season", "pack_date")


@query
def season_to_date_joined(x):
    limits = bnd.season_bounds(x.batches, SITE, month_day=MONTH_DAY)
    rows = bnd.season_to_date(x.deliveries, limits, "harvest_date", lower="first_harvest", upper="le")
    return rows.select("bin_delivery_id", "season", "harvest_date")


@query
def season_to_date_twice(x):
    """Every season listed twice, the second time a day later and for a shorter time."""
    limits = bnd.season_bounds(x.batches, SITE, month_day=MONTH_DAY)
    later = limits.withColumns({"first_pack": F.date_add("first_pack", 1), "close": F.date_sub("close", 3)})
    rows = bnd.season_to_date(x.site_batches, limits.unionByName(later), "pack_date", lower="first_pack", upper="lt")
    return rows.select("grader_batch_id", "season", "pack_date")


@query
def season_to_date_many(x):
    """Bounds of more than 64 seasons: a season for each pack day."""
    rows = x.batches.select("grader_batch_id", F.date_diff("pack_date", F.lit("1990-01-01").cast("date")).alias("season"), "pack_date")
    limits = rows.groupBy("season").agg(F.min("pack_date").alias("first_pack"), F.max("pack_date").alias("close"))
    return bnd.season_to_date(rows, limits, "pack_date", lower="first_pack")


# --- harvest ---------------------------------------------------------------------------------

@query
def harvest_by_site(x):
    return hv.harvest_by_site(x.deliveries, x.bounds, SITES[:2])


@query
def harvest_duration(x):
    return hv.harvest_duration(x.deliveries)


@query
def harvest_rate(x):
    return hv.harvest_rate(x.deliveries, [PRIOR, CURRENT])


@query
def harvest_growth(x):
    return hv.harvest_growth(hv.harvest_total(x.deliveries, x.bounds), x.bounds, CURRENT, PRIOR)


@query
def pick_share(x):
    return hv.pick_share(x.deliveries)


@query
def cumulative_harvest(x):
    recent = x.deliveries.filter(F.col("season") >= PRIOR)
    older = x.deliveries.filter(F.col("season") < PRIOR).drop("pick_no")
    both = rel.union_sources({"current": recent, "archive": older})
    return hv.cumulative_harvest(both, x.bounds, MONTH_DAY)


@query
def tipped_by_site(x):
    return hv.tipped_by_site(x.tipped, x.bounds, [PRIOR, CURRENT]).withColumnsRenamed(
        {str(PRIOR): "prior", str(CURRENT): "current"}
    )


@query
def tipped_growth(x):
    return hv.tipped_growth(x.tipped, x.bounds, CURRENT, PRIOR)


# --- packout ---------------------------------------------------------------------------------

@query
def packout_by_batch(x):
    return finite(x.site_batches, "packout").select(
        "grader_batch_id", "season", "pack_date", "storage_days", "iso_week", "packout", "packout_state"
    )


@query
def known_packout(x):
    return finite(po.known_packout(x.site_batches), "packout").select("grader_batch_id", "packout", "packout_state")


@query
def packout_scatter(x):
    return finite(po.packout_scatter(x.site_batches, CURRENT), "packout")


@query
def packout_to_date(x):
    return po.packout_to_date(x.site_batches, month_day=MONTH_DAY)


@query
def packout_in_bounds(x):
    return po.packout_aggregate(x.site_batches, x.bounds)


@query
def packout_to_date_closed(x):
    return po.packout_aggregate(x.site_batches, x.bounds, upper="le")


@query
def packout_first_week(x):
    recent = x.site_batches.filter(F.col("season").isin(PRIOR, CURRENT))
    return po.packout_to_date(recent, days=7)


@query
def packout_whole_season(x):
    return po.packout_aggregate(x.site_batches, None, seasons=[CURRENT])


@query
def packout_population(x):
    return po.packout_population(x.batches, x.bounds)


@query
def storage_day_cap(x):
    plain = packing_data.grader_batch(x.t, aggregate_samples=True)
    rows = po.storage_day_cap(x.closed_batches, CURRENT, po.packout_by_batch(plain, SITE, closed_only=True))
    return rows.groupBy("season").agg(F.count("storage_days").alias("n"), F.max("storage_days").alias("longest"))


@query
def storage_day_points(x):
    rows = po.storage_day_cap(x.closed_batches, CURRENT).filter(F.col("season") == CURRENT)
    return finite(rows, "packout").select("grader_batch_id", "season", "storage_days", "packout_state")


@query
def packout_regression(x):
    figures = ["intercept", "slope", "se_intercept", "se_slope", "mean_days", "sd_resid"]
    return rounded(x.regression, 8, *figures).withColumn("sxx", F.round("sxx", 4))


@query
def packout_slope_ratio(x):
    return rounded(po.slope_ratio(x.regression, PRIOR, CURRENT), 8, "ratio")


@query
def packout_trend_line(x):
    return rounded(po.trend_line(x.regression), 8, "fit", "se_fit", "lower", "upper")


@query
def t_quantiles(x):
    """Quantiles for groups of few batches."""
    groups = x.site_batches.groupBy("season", "pack_date").agg(F.count(F.lit(1)).alias("n"))
    return groups.select("season", "pack_date", "n", F.round(sc.t_quantile(F.col("n") - 2, 0.975), 8).alias("q"))


# --- defects ---------------------------------------------------------------------------------

@query
def sample_qty(x):
    return dfc.sample_qty_by_batch(x.assessments)


@query
def sample_qty_to_date(x):
    return dfc.sample_qty_by_batch(x.assessments, x.bounds)


@query
def batch_defects(x):
    return finite(x.proportions, "prop")


@query
def batch_defects_by_input(x):
    rows = dfc.batch_defect_proportion(
        quality_data.defects(x.t), x.assessments, dfc.sample_qty_by_batch(x.assessments), x.batches, drop="input"
    )
    return finite(rows, "prop")


@query
def defect_profile(x):
    return x.profile


@query
def top_defects(x):
    return dfc.top_defects(x.profile, CURRENT)


@query
def defects_first_week(x):
    week = bnd.season_bounds(x.batches, SITE, days=7, seasons=[PRIOR, CURRENT])
    proportions = dfc.batch_defect_proportion(
        quality_data.defects(x.t), x.assessments, dfc.sample_qty_by_batch(x.assessments), x.batches, drop="input")
    return dfc.defect_profile(proportions, week)


@query
def top_defect_lines(x):
    top = dfc.top_defects(x.profile, CURRENT).filter(F.col("season") == CURRENT)
    return rel.keep_members(quality_data.defects(x.t), top, "defect")


@query
def null_safe_join(x):
    found = dfc.defect_qty_by_batch(quality_data.defects(x.t), x.assessments)
    return rel.join_null_safe(found, dfc.sample_qty_by_batch(x.assessments), ["grader_batch_id"])


@query
def null_spread_join(x):
    """Assessments beside the samples of their batch; where half of them have no batch, those meet the samples without one."""
    half = F.when(F.col("assessment_id") % 2 == 0, F.col("grader_batch_id")).alias("grader_batch_id")
    left = x.assessments.select("assessment_id", half)
    samples = dfc.sample_qty_by_batch(x.assessments)
    return rel.join_null_spread(left, samples, ["grader_batch_id"], "left", rows_per_task=500)


# --- pests -----------------------------------------------------------------------------------

@query
def phyto_lot_summary(x):
    return x.lot_summary


@query
def phyto_with_requirements(x):
    return ph.with_requirements(x.lot_summary, phyto_data.lot_pip_requirements(x.t))


@query
def phyto_with_lot_requirements(x):
    return x.lot_findings


@query
def interception_rate(x):
    return ph.interception_rate(x.lot_findings, phyto_data.mpi_lots(x.t), x.bounds, EXCLUDED)


@query
def interception_rate_full(x):
    return ph.interception_rate(x.lot_findings, phyto_data.mpi_lots(x.t), None, EXCLUDED)


@query
def pest_counts(x):
    return x.pests


@query
def pest_order(x):
    return ph.order_by_season(x.pests, PRIOR, "defect", "defect_qty")


# --- fruit size ------------------------------------------------------------------------------

@query
def size_moments(x):
    return rounded(x.moments, 6, *[c for c in x.moments.columns if c != "season"])


@query
def yoy_change(x):
    diameter = sz.yoy_change(x.moments, "mean_eq").withColumn("measure", F.lit("diameter"))
    mass = sz.yoy_change(x.moments, "mean_mass").withColumn("measure", F.lit("mass"))
    return rounded(diameter.unionByName(mass), 8, "value", "yoy")


@query
def density_curve(x):
    return rounded(sz.density_curve(x.moments, "eq", 36, 76), 8, "density", "mean")


@query
def density_curve_mass(x):
    return rounded(sz.density_curve(x.moments, "mass", 0, 4000, 100), 8, "density").drop("mean")


@query
def size_band_share(x):
    return x.bands


@query
def size_band_pivot(x):
    return sz.size_band_pivot(x.bands)


@query
def size_moments_merged(x):
    """Moments landed by day in two runs, of which the second replaces the last days of the first, and merged."""
    folder = work_folder(x.spark, "moments")
    early = x.fruit.filter(F.col("start_time") < "2000-03-15 12:00:00")
    sz.land_moment_days(early, folder)
    sz.land_moment_days(x.fruit, folder, since="2000-03-10")
    moments = sz.moments_of_parts(x.spark.read.parquet(folder))
    return rounded(moments, 6, *[c for c in moments.columns if c != "season"])


@query
def size_histogram_default(x):
    """Diameters and tube shares in bins whose edges follow from the range."""
    diameters = sz.default_histogram(x.fruit, "minor").withColumn("measure", F.lit("minor"))
    shares = sz.default_histogram(sz.size_band_pivot(x.bands), "Tube", bins=12).withColumn("measure", F.lit("Tube"))
    return rounded(diameters.unionByName(shares), 8, "low", "high")


@query
def size_histogram(x):
    return sz.histogram(sz.size_band_pivot(x.bands), "FP", lo=0.0, width=1 / 32, bins=32)


# --- report ----------------------------------------------------------------------------------

@query
def season_kpis(x):
    return season_table(x.deliveries, x.tipped, x.batches, SITE, MONTH_DAY)


@query
def display_strings(x):
    kpis = season_table(x.deliveries, x.tipped, x.batches, SITE, MONTH_DAY)
    return kpis.select(
        F.col("season").alias("Season"),
        sc.thousands_text("bins").alias("Bins harvested"),
        sc.long_date_text("first_pack").alias("First pack"),
        sc.percent_text("packout").alias("Packout"),
    )


@query
def display_rounding(x):
    change = sz.yoy_change(x.moments, "mean_eq")
    return change.select(
        "season", sc.round_half_even("value", 1).alias("mm"), sc.percent_text("yoy", 1).alias("yoy_change")
    )


# --- relational primitives -------------------------------------------------------------------

@query
def project_filter(x):
    rows = x.deliveries.drop("bin_delivery_id").filter(
        ~F.col("presize_flag")
        & (F.col("harvest_date") >= "1996-01-15")
        & (F.col("harvest_date") <= "2000-12-20")
        & ((F.col("storage_site") != SITES[0]) | (F.col("pick_no") == 1) & (F.col("no_of_bins") > 40))
    )
    return rel.relocate_first(rows.withColumn("half_bins", F.col("no_of_bins") * 0.5), "storage_site")


@query
def in_null(x):
    graded = x.t["STG_COMPAC_BATCH"].withColumn("season", F.year("START_TIME"))
    out = ["Juice", "Low Colour"]
    count = F.count(F.lit(1))
    return (
        graded.groupBy("season")
        .agg(
            F.count_if(sc.not_in("SIZER_GRADE_NAME", out, keep_null=False)).alias("sql_rule"),
            F.count_if(sc.not_in("SIZER_GRADE_NAME", out, keep_null=True)).alias("frame_rule"),
            F.count_if(F.col("SIZER_GRADE_NAME").isNull()).alias("missing"),
            F.count_if(F.col("SIZER_GRADE_NAME").isin(out)).alias("listed"),
            count.alias("total"),
        )
    )


@query
def fact_join(x):
    batches = x.batches.select("grader_batch_id", "reject_kgs")
    return x.tipped.join(batches, "grader_batch_id", "left").select(
        "grader_batch_id", "season", "packing_site", "no_of_bins_tipped", "reject_kgs"
    )


@query
def group_sums(x):
    return x.t["qa_AssessmentT"].groupBy(F.col("TemplateID").alias("template_id")).agg(
        agg.sum_or_null("SampleQty").alias("propagate"),
        agg.sum_or_zero("SampleQty").alias("skip_zero"),
        agg.sum_skip_null("SampleQty").alias("skip_null"),
        F.count("SampleQty").alias("present"),
        F.count(F.lit(1)).alias("n"),
    )


@query
def group_forms(x):
    lines = x.t["ma_Pallet_DetailT"].join(x.t["sw_ProductT"], "ProductID")
    by_flag = lines.groupBy(F.col("SampleFlag").cast("string").alias("key")).agg(
        F.sum(F.col("NoOfUnits") * F.col("NetFruitWeight")).cast("double").alias("kgs")
    )
    overall = lines.agg(F.sum("NoOfUnits").alias("units")).withColumn("key", F.lit("all"))
    dates = x.batches.agg(
        F.min("harvest_date").alias("first"), F.max("pack_date").alias("last"), F.max("farm_name").alias("text")
    ).withColumn("key", F.lit("dates"))
    return by_flag.unionByName(overall, allowMissingColumns=True).unionByName(dates, allowMissingColumns=True)


@query
def group_seven_keys(x):
    keys = ["season", "pack_site", "production_site", "maturity_code", "storage_type", "pick_no", "pack_date"]
    return x.batches.groupBy(*keys).agg(F.count("input_kgs").alias("n"), F.sum("input_kgs").alias("input_kgs"))


@query
def sort_nulls_topn(x):
    order = [F.col("SampleQty").asc_nulls_last(), F.col("AssessmentID").asc()]
    return x.t["qa_AssessmentT"].orderBy(*order).limit(15).select(
        F.col("AssessmentID").alias("assessment_id"), F.col("SampleQty").alias("sample_qty")
    )


@query
def keyed_pick(x):
    first = hv.pick_share(x.deliveries).filter((F.col("pick_no") == 1) & F.col("season").isin(PRIOR, CURRENT))
    return first.select("season", "share")


@query
def row_bind(x):
    bins = hv.harvest_total(x.deliveries, x.bounds).withColumnRenamed("bins", "harvested")
    tipped = hv.tipped_total(x.tipped, x.bounds).select(
        F.col("season").alias("tipped_season"), F.col("bins").alias("tipped")
    )
    return rel.bind_columns(bins, tipped, "season", "tipped_season", work_folder(x.spark, "row_bind"))


@query
def row_bind_rows(x):
    """The n-th delivery by harvest date beside the n-th batch by pack date, over all rows of both."""
    left = x.deliveries.select("harvest_date", "bin_delivery_id", "no_of_bins")
    right = x.batches.select("pack_date", "grader_batch_id", "input_kgs")
    return rel.bind_columns(
        left, right, ["harvest_date", "bin_delivery_id"], ["pack_date", "grader_batch_id"], work_folder(x.spark, "row_bind_rows"))


@query
def running_rows(x):
    """Running weights of every batch of a season and site, and of a season, unknown from the first unknown weight on."""
    rows = x.batches.select("season", "pack_site", "pack_date", "grader_batch_id", "input_kgs", "reject_kgs")
    kgs = ordered.running_total(
        rows, "input_kgs", ["season", "pack_site"], ["pack_date", "grader_batch_id"], "running_kgs", work_folder(x.spark, "running_kgs"))
    return ordered.running_total(
        kgs, "reject_kgs", ["season"], ["pack_date", "grader_batch_id"], "running_reject", work_folder(x.spark, "running_reject")
    ).drop("pack_site")


@query
def union_by_name(x):
    recent = x.deliveries.filter(F.col("season") >= PRIOR)
    older = x.deliveries.filter(F.col("season") < PRIOR).drop("pick_no")
    both = rel.union_sources({"current": recent, "archive": older})
    return both.groupBy("source_db", "season", "pick_no").agg(F.sum("no_of_bins").alias("bins"))


@query
def closed_bin_cte(x):
    usage, batches = x.t["ma_Bin_UsageT"], x.t["ma_Grader_BatchT"]
    return x.spark.sql(
        """
        WITH used AS (
          SELECT u.BinDeliveryID, u.BinQty, b.ClosedDateTime IS NOT NULL AS closed
          FROM {usage} u JOIN (SELECT GraderBatchID, ClosedDateTime FROM {batches}) b USING (GraderBatchID)
        )
        SELECT BinDeliveryID AS bin_delivery_id, closed, sum(BinQty) AS bin_qty FROM used GROUP BY ALL
        """,
        usage=usage, batches=batches,
    )


@query
def season_label(x):
    label = sc.season_label("START_TIME", SEASONS[2], SEASONS[-2], other=1900)
    return x.t["STG_COMPAC_BATCH"].groupBy(label.alias("season")).agg(F.count(F.lit(1)).alias("n"))


@query
def date_parts(x):
    return x.batches.select(
        "grader_batch_id",
        sc.iso_week("pack_date").alias("iso_week"),
        sc.days_between("harvest_date", "pack_date").alias("storage_days"),
        sc.plus_days("harvest_date", 7).alias("week_later"),
        sc.move_to_year("harvest_date", 2024).alias("plot_date"),
        sc.date_in_year("season", MONTH_DAY).alias("close"),
        sc.to_int(F.substring("farm_code", 2, 10)).alias("farm_number"),
        sc.day_of(sc.timestamp_of(F.concat(F.col("pack_date").cast("string"), F.lit(" 08:30:00")))).alias("pack_day"),
    )


@query
def many_columns(x):
    wide = hv.harvest_by_site(x.deliveries, x.bounds, SITES)
    order = Window.orderBy(F.col("total").asc_nulls_last(), "season")
    shares = [sc.ratio(f"`{s}`", "total").alias(f"share_{s}") for s in SITES]
    return wide.select("season", F.row_number().over(order).alias("rank"), *shares)


@query
def footer_extents(x):
    """First and last days of each season from the footers of batches that were landed by season."""
    folder = work_folder(x.spark, "batches")
    rows = x.batches.select("season", "pack_date", "harvest_date", "grader_batch_id", "pack_site")
    write_dataset(rows, folder)
    return footer_extent(read_for_footers(x.spark, folder), "season", ["harvest_date", "pack_date", "grader_batch_id"])


@query
def dataset_rerun(x):
    """Batches by season, of which a second run replaces two seasons; a failed one and one of an emptied season do the rest."""
    folder = work_folder(x.spark, "rerun")
    rows = x.batches.select("grader_batch_id", "season", "pack_site", "input_kgs")
    replace_partitions(rows, folder, ["season"])
    again = rows.filter(F.col("season").isin(PRIOR, CURRENT) & (F.col("pack_site") == SITE)).withColumn("input_kgs", F.lit(1).cast("decimal(18,4)"))
    replace_partitions(again, folder, ["season"])
    covers = rows.select("season").distinct().filter(F.col("season").isin(PRIOR - 1, PRIOR))
    replace_partitions(again.filter(F.col("season") == PRIOR), folder, ["season"], covers=covers)
    return x.spark.read.parquet(folder)


@query
def csv_round_trip(x):
    """The harvest curve as CSV, by season, read back with its declared columns."""
    folder = work_folder(x.spark, "curve")
    curve = hv.cumulative_harvest(x.deliveries, x.bounds, MONTH_DAY).select(
        F.col("season").cast("int").alias("Season"), F.col("harvest_date").alias("HarvestDate"),
        F.col("bins").cast("bigint").alias("NoOfBins"), F.col("cum_bins").cast("bigint").alias("cumBins"), F.col("plot_date").alias("PlotDate"))
    sinks.write_csv(curve, folder)
    return files.read_csv(x.spark, folder, files.HARVEST_CURVE).withColumnsRenamed(
        {"Season": "season", "HarvestDate": "harvest_date", "NoOfBins": "no_of_bins", "cumBins": "cum_bins", "PlotDate": "plot_date"})


@query
def report_runs(x):
    """A report table and a figure of two weekly runs, the second repeated; the newest table and the first figure are read."""
    root = work_folder(x.spark, "report")
    totals = hv.harvest_total(x.deliveries, x.bounds)
    site = packing_display()
    for run, least in (("2001-04-13", 0), ("2001-04-20", 1), ("2001-04-20", 1)):
        sinks.write_run({"totals": totals.filter(F.col("season") > SEASONS[0] + least), "points": totals}, root, run, displays=site)
    table = sinks.read_run(x.spark, f"{root}/totals").select(F.col("Season").alias("season"), F.col("Bins").alias("bins"))
    points = sinks.read_run(x.spark, f"{root}/points", "2001-04-13").select("season", F.col("bins").cast("string").alias("bins"))
    return table.withColumn("part", F.lit("table")).unionByName(points.withColumn("part", F.lit("figure")))


def packing_display() -> dict[str, sinks.Display]:
    return {"totals": sinks.Display({"season": "Season", "bins": "Bins"}, order_by=["season"], thousands=["bins"])}


@query
def season_to_date_landed(x):
    """Batches landed by season, of which the bounds of two seasons open only their folders."""
    folder = work_folder(x.spark, "site_batches")
    rows = land(x.site_batches.select("grader_batch_id", "season", "pack_date", "input_kgs"), folder, by="season")
    limits = bnd.season_bounds(x.batches, SITE, month_day=MONTH_DAY, seasons=[PRIOR, CURRENT])
    limits = bnd.land_bounds(limits, work_folder(x.spark, "pair_bounds"))
    return bnd.season_to_date(rows, limits, "pack_date", lower="first_pack", upper="lt", landed=True)


@query
def pushed_scan(x):
    """Filter, projection and partial aggregation on the fruit scan."""
    rows = x.t["STG_COMPAC_BATCH"].filter((F.col("START_TIME") >= "1999-06-01") & (F.col("START_TIME") < "2000-06-01"))
    return rows.groupBy(F.col("GROWER_CODE").alias("grower_code")).agg(
        F.count(F.lit(1)).alias("n"), F.min("MINOR").alias("least"), F.max("MINOR").alias("most")
    )
