"""The whole season report: every table and figure frame from the source tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropline.operators import bounds as bnd
from cropline.operators import defects as dfc
from cropline.operators import harvest as hv
from cropline.operators import packout as po
from cropline.operators import phyto as ph
from cropline.operators import size as sz
from cropline.operators.relational import union_sources
from cropline.plans import fruit_data, harvest_data, packing_data, phyto_data, quality_data
from cropline.plans.dimensions import Tables
from cropline.plans.season_report import season_kpis
from cropline.sources.sinks import Display
from cropline.sources.tables import land


@dataclass(frozen=True)
class ReportSettings:
    """What one edition of the report is about. ``month_day`` is the close day, such as ``-04-20``."""

    site: str
    storage_sites: Sequence[str]
    current: int
    prior: int
    month_day: str
    archive_seasons: Sequence[int] = ()
    markets: Sequence[str] = phyto_data.MARKETS
    excluded_pests: Sequence[str] = field(default=ph.EXCLUDED_PESTS)
    plot_year: int = 2024
    top: int = 15

    @property
    def pair(self) -> list[int]:
        return [self.prior, self.current]

    @property
    def seasons(self) -> list[int]:
        return [*self.archive_seasons, *self.pair]


def displays(settings: ReportSettings) -> dict[str, Display]:
    """The shown form of the report's tables, for ``sinks.write_chart_data``; figures keep their raw values."""
    season = {"season": "Season"}
    sites = [*settings.storage_sites, "other_sites", "no_site", "total"]
    site_names = dict(zip(sites, [*settings.storage_sites, "Other sites", "No site", "Total"]))
    packout = Display({**season, "packout": "Packout"}, ["season"], percent={"packout": 1})
    pair = [str(s) for s in settings.pair]
    return {
        "bins_harvested_by_site": Display({**season, **site_names}, ["season"], thousands=sites),
        "bins_tipped_by_site": Display(
            {"packing_site": "Packing site", **{s: s for s in pair}}, ["packing_site"], thousands=pair),
        "packout_to_date": packout,
        "packout_first_week": packout,
        "packout_model": Display(
            {**season, "intercept": "Zero day Packout", "slope": "Packout loss per day"}, ["season"],
            percent={"intercept": 1, "slope": 2}),
        "interception_rate": Display(
            {**season, "with_interceptions": "With interceptions", "total": "Total", "rate": "% bugged out"}, ["season"],
            percent={"rate": 1}),
        "diameter_change": Display(
            {**season, "value": "mm", "yoy": "YoY change"}, ["season"], percent={"yoy": 1}, rounded={"value": 1}),
        "mass_change": Display(
            {**season, "value": "g", "yoy": "YoY change"}, ["season"], percent={"yoy": 1}, rounded={"value": 1}),
    }


def report_frames(
    t: Tables, settings: ReportSettings, work: str, archive: Tables | None = None
) -> dict[str, DataFrame]:
    """``{table or figure: frame}``. ``archive`` holds the tables of a database with older seasons,
    whose batches reach their production site through the block.

    ``work`` is a folder that driver and executors share; what several frames start from is landed there once
    (batches, bounds, findings, and the few rows of the packout model and the size moments).
    """
    s = settings
    keep = lambda df, name, by=None: land(df, f"{work.rstrip('/')}/{name}", by)
    batches = keep(packing_data.grader_batch_detail(t), "batches", "season")
    deliveries = harvest_data.bins_harvested_pick(t)
    tipped = packing_data.bins_tipped(t)
    bounds = keep(bnd.season_bounds(batches, s.site, month_day=s.month_day, seasons=s.pair), "bounds")

    curve_source, curve_bounds, closed = deliveries, bounds, packing_data.grader_batch(t)
    if archive is not None:
        older = bnd.season_bounds(
            packing_data.grader_batch_dates(archive), month_day=s.month_day, seasons=s.archive_seasons
        )
        curve_bounds = keep(bounds.unionByName(older), "curve_bounds")
        curve_source = union_sources({"current": deliveries, "archive": harvest_data.bins_harvested(archive)})
        closed = closed.unionByName(packing_data.grader_batch_by_block(archive))

    site_batches = po.packout_by_batch(batches, s.site)
    model_batches = po.packout_by_batch(closed, s.site, closed_only=True)
    regression = keep(po.packout_regression(model_batches, cap_season=s.current), "packout_model")
    week_batches = site_batches.filter(F.col("season").isin(s.pair))

    assessed = quality_data.defect_assessments(t)
    proportions = dfc.batch_defect_proportion(
        quality_data.defects(t), assessed, dfc.sample_qty_by_batch(assessed, bounds), batches
    )
    findings = keep(phyto_data.phyto_assessments(t, s.markets), "findings")
    lots = phyto_data.mpi_lots(t)
    needed = phyto_data.findings_with_requirements(
        t, ph.phyto_lot_summary(findings, phyto_data.mpi_lot_detail(t))
    )
    pests = ph.pest_counts(findings, phyto_data.lot_ids(t), bounds)
    moments = keep(sz.size_moments(fruit_data.fruit_measurements(t, s.seasons, s.month_day)), "size_moments")
    bands = sz.size_band_share(fruit_data.fruit_measurements(t, [s.prior]))
    week_bounds = bnd.season_bounds(batches, s.site, days=7, seasons=s.pair)
    week_profile = dfc.defect_profile(
        dfc.batch_defect_proportion(
            quality_data.defects(t), assessed, dfc.sample_qty_by_batch(assessed), batches, drop="input"), week_bounds)

    return {
        "season_kpis": season_kpis(deliveries, tipped, batches, s.site, s.month_day, s.pair),
        "bins_harvested_by_site": hv.harvest_by_site(deliveries, bounds, s.storage_sites),
        "harvest_rate": hv.harvest_rate(deliveries, s.pair),
        "pick_share": hv.pick_share(deliveries).filter(F.col("season").isin(s.pair)),
        "harvest_growth": hv.harvest_growth(hv.harvest_total(deliveries, bounds), bounds, s.current, s.prior),
        "harvest_curve": hv.cumulative_harvest(curve_source, curve_bounds, s.month_day, s.plot_year),
        "bins_tipped_by_site": hv.tipped_by_site(tipped, bounds, s.pair),
        "tipped_growth": hv.tipped_growth(tipped, bounds, s.current, s.prior),
        "packout_to_date": po.packout_aggregate(site_batches, bounds),
        "packout_first_week": po.packout_to_date(week_batches, days=7),
        "packout_by_storage_days": po.storage_day_cap(model_batches, s.current).select("season", "storage_days", "packout"),
        "packout_population": po.packout_population(batches, bounds),
        "packout_by_pack_date": po.packout_scatter(site_batches, s.current),
        "packout_model": regression,
        "packout_trend": po.trend_line(regression),
        "packout_slope_ratio": po.slope_ratio(regression, s.prior, s.current),
        "top_defects": dfc.top_defects(dfc.defect_profile(proportions, bounds), s.current, s.top),
        "first_week_defects": dfc.top_defects(week_profile, s.current, s.top),
        "interception_rate_full": ph.interception_rate(needed, lots, None, s.excluded_pests),
        "interception_rate": ph.interception_rate(needed, lots, bounds, s.excluded_pests),
        "pest_counts": ph.order_by_season(pests, s.prior, "defect", "defect_qty"),
        "size_moments": moments,
        "size_histogram": sz.histogram(sz.size_band_pivot(bands), "FP", lo=0.0, width=1 / 32, bins=32),
        "diameter_density": sz.density_curve(moments, "eq", 36, 76),
        "mass_density": sz.density_curve(moments, "mass", 0, 160),
        "diameter_change": sz.yoy_change(moments, "mean_eq"),
        "mass_change": sz.yoy_change(moments, "mean_mass"),
    }
