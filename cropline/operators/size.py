"""Fruit size: moments by season, density curves, size bands and histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cropline.functions.scalars import normal_pdf, ratio
from cropline.operators.relational import join_null_safe, pivot_wider
from cropline.sources.sinks import replace_partitions

# Size names of the packed bands, and the label of every other size.
SIZE_BANDS = {
    "FP": ("53/2", "53/5", "58/5", "63/5"),
    "Tube": ("63/3", "63/4", "67/4", "72/4"),
}
OTHER_BAND = "OOS"


#: Name of each measure in the moments, and its column.
MEASURES = {"eq": "minor", "sl": "major", "elong": "elongation", "mass": "weight", "vol": "volume"}
#: The two measures of which the covariance is kept.
PAIR = ("minor", "elongation")


def size_moments(fruit: DataFrame) -> DataFrame:
    """Mean and sample deviation by season, and the covariance of diameter and elongation: one pass."""
    moments = []
    for name, column in MEASURES.items():
        moments += [F.avg(column).alias(f"mean_{name}"), F.stddev_samp(column).alias(f"sd_{name}")]
    return fruit.groupBy("season").agg(*moments, F.covar_samp(*PAIR).alias("covar"))


def moment_parts(fruit: DataFrame, by: Sequence[str] = ("season", "day")) -> DataFrame:
    """Per part: count, mean and sum of squared deviations of each measure, and the same and co-deviation of the pair.

    Parts of any size can be put together again by ``merge_parts``, in any order, without the fruit.
    """
    x, y = PAIR
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    parts = []
    for name, column in MEASURES.items():
        n = F.count(column)
        parts += [n.alias(f"n_{name}"), F.avg(column).alias(f"mean_{name}"), (F.var_pop(column) * n).alias(f"dev_{name}")]
    n = F.count_if(both)
    parts += [n.alias("n_pair"), F.avg(F.when(both, F.col(x))).alias("pair_x"), F.avg(F.when(both, F.col(y))).alias("pair_y"),
              (F.covar_pop(x, y) * n).alias("dev_pair")]
    return fruit.groupBy(*by).agg(*parts)


def merge_parts(parts: DataFrame, by: Sequence[str] = ("season",)) -> DataFrame:
    """Parts put together: the deviations inside each, and those of its mean from the mean of all, so nothing cancels."""
    means = {f"mean_{name}": f"n_{name}" for name in MEASURES} | {"pair_x": "n_pair", "pair_y": "n_pair"}
    whole = parts.groupBy(*by).agg(*[
        ratio(F.sum(F.col(n) * F.col(mean)), F.sum(n)).alias(f"all_{mean}") for mean, n in means.items()])
    joined = join_null_safe(parts, whole, list(by))
    off = lambda mean: F.col(mean) - F.col(f"all_{mean}")
    merged = []
    for name in MEASURES:
        n, mean = f"n_{name}", f"mean_{name}"
        merged += [F.sum(n).alias(n), F.max(f"all_{mean}").alias(mean),
                   F.sum(F.col(f"dev_{name}") + F.col(n) * off(mean) * off(mean)).alias(f"dev_{name}")]
    merged += [F.sum("n_pair").alias("n_pair"), F.max("all_pair_x").alias("pair_x"), F.max("all_pair_y").alias("pair_y"),
               F.sum(F.col("dev_pair") + F.col("n_pair") * off("pair_x") * off("pair_y")).alias("dev_pair")]
    return joined.groupBy(*by).agg(*merged)


def moments_of_parts(parts: DataFrame) -> DataFrame:
    """What ``size_moments`` gives for the fruit of all parts."""
    merged = merge_parts(parts)
    sample = lambda dev, n: F.when(F.col(n) > 1, F.col(dev) / (F.col(n) - 1))
    out = []
    for name in MEASURES:
        out += [F.col(f"mean_{name}"), F.sqrt(sample(f"dev_{name}", f"n_{name}")).alias(f"sd_{name}")]
    return merged.select("season", *out, sample("dev_pair", "n_pair").alias("covar"))


def land_moment_days(fruit: DataFrame, folder: str, since: str | None = None) -> None:
    """Land the parts of each season and day, in a folder for each month, from the month of the day ``since`` on.

    Months that are there already are replaced, so a weekly run reads the fruit of the months that have new days only, and
    gives the same parts if it is repeated.
    """
    dated = fruit.withColumn("day", F.to_date("start_time"))
    if since is not None:
        dated = dated.filter(F.col("start_time") >= F.lit(f"{since[:7]}-01 00:00:00"))
    parts = moment_parts(dated).withColumn("month", F.date_format("day", "yyyy-MM"))
    replace_partitions(parts.repartition("season", "month"), folder, ["season", "month"])


def density_curve(moments: DataFrame, which: str, lo: int, hi: int, step: int = 1) -> DataFrame:
    """Normal density per season on a grid, from ``mean_<which>`` and ``sd_<which>``."""
    mean, sd = f"mean_{which}", f"sd_{which}"
    grid = moments.withColumn("x", F.explode(F.sequence(F.lit(lo), F.lit(hi), F.lit(step))))
    return grid.select(
        "season", "x", normal_pdf(F.col("x").cast("double"), mean, sd).alias("density"), F.col(mean).alias("mean")
    )


def yoy_change(moments: DataFrame, column: str) -> DataFrame:
    """Value and its change from the previous listed season. ``moments`` has one row per season."""
    previous = F.lag(column).over(Window.orderBy("season"))
    return moments.select("season", F.col(column).alias("value"), (ratio(column, previous) - 1).alias("yoy"))


def size_band_share(
    fruit: DataFrame, bands: Mapping[str, Sequence[str]] = SIZE_BANDS, other: str = OTHER_BAND
) -> DataFrame:
    """Fruit count and share of batch per size band, for the bands a batch has.

    All bands of a batch are counted in one aggregation and then unfolded, which takes one shuffle
    where counting by (batch, band) and then totalling by batch would take two.
    """
    size = F.col("size_name")
    named = [size.isin(list(sizes)) for sizes in bands.values()]
    counts = [F.count_if(c).alias(b) for b, c in zip(bands, named)]
    total = F.count(F.lit(1)).alias("total")
    wide = fruit.groupBy("batch_id").agg(*counts, total)
    rest = F.col("total") - sum(F.col(f"`{b}`") for b in bands)
    cells = [F.struct(F.lit(b).alias("band"), F.col(f"`{b}`").alias("n")) for b in bands]
    cells.append(F.struct(F.lit(other).alias("band"), rest.alias("n")))
    return (
        wide.select("batch_id", "total", F.inline(F.array(*cells)))
        .filter("n > 0")
        .select("batch_id", "band", "n", ratio("n", "total").alias("share"))
    )


def size_band_pivot(shares: DataFrame, bands: Sequence[str] = (*SIZE_BANDS, OTHER_BAND)) -> DataFrame:
    """One column per band with the batch's share, 0 where the batch has none."""
    return pivot_wider(shares, ["batch_id"], "band", "share", bands, fill=0.0)


def histogram(df: DataFrame, column: str, lo: float, width: float, bins: int = 30) -> DataFrame:
    """Row counts in equal bins [lo + i*width, lo + (i+1)*width), empty bins included.

    The last bin includes its upper edge. Values outside the bins are counted under their own bin
    number; nulls are left out.
    """
    at = F.floor((F.col(column) - lo) / F.lit(float(width)))
    top_edge = F.col(column) == F.lit(lo + bins * width)
    counted = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.when(top_edge, F.lit(bins - 1).cast("bigint")).otherwise(at).alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    spine = df.sparkSession.range(bins).select(F.col("id").alias("bin"), F.lit(0).cast("bigint").alias("count"))
    return counted.unionByName(spine).groupBy("bin").agg(F.sum("count").alias("count"))


def default_histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin, low, high and count of ``bins`` equal bins whose edges follow from the column's range, empty bins included.

    The least value is the middle of the first bin and the greatest that of the last; a bin has its upper edge but not its
    lower one, and a value less than a hundred millionth of a width above an edge counts as on it. Where all values are
    equal there is one bin, a tenth wide. Nulls are left out; without a value there is no bin.

    The source is read once: values are counted first, and both the range and the bins come from that one shuffle.
    """
    if bins < 2:
        raise ValueError(f"there must be two bins or more, not {bins}")
    values = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ends = values.agg(F.min("value").alias("least"), F.max("value").alias("most"))
    least, most = ends.select("least").scalar(), ends.select("most").scalar()
    placed = values.withColumns({"least": least, "most": most})
    flat = F.col("least") == F.col("most")
    width = F.when(flat, 0.1).otherwise((F.col("most") - F.col("least")) / (bins - 1))
    # With one value the edges lie at whole and a half tenths, as for any given width without a range.
    low = F.when(flat, F.floor((F.col("least") - 0.05) / 0.1) * 0.1 + 0.05).otherwise(F.col("least") - width / 2)
    at = F.greatest(F.ceil((F.col("value") - F.col("low")) / F.col("width") - 1e-8) - 1, F.lit(0).cast("bigint"))
    counted = placed.withColumns({"width": width, "low": low}).withColumn("bin", at)
    counted = counted.groupBy("bin").agg(F.sum("n").alias("count"), F.max("low").alias("low"), F.max("width").alias("width"), F.max(flat).alias("flat"))
    every = counted.agg(F.max("low").alias("low"), F.max("width").alias("width"), F.max("flat").alias("flat")).filter("low is not null")
    last = F.when(F.col("flat"), 0).otherwise(bins - 1).cast("bigint")
    spine = every.select("low", "width", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("bin"))
    return spine.join(counted.select("bin", "count"), "bin", "left").select(
        "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("low"), (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("high"),
        F.coalesce("count", F.lit(0)).alias("count"))
