"""Column expressions. All are built-in Spark expressions, so they stay inside codegen."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- arithmetic and missing values ---

def ieee_div(x: Column | str, y: Column | str) -> Column:
    """x / y as doubles with floating-point zero rules: x/0 is +-Infinity, 0/0 is NaN, null stays null."""
    x, y = _col(x).cast("double"), _col(y).cast("double")
    return (
        F.when(x.isNull() | y.isNull(), F.lit(None).cast("double"))
        .when(y != 0, F.try_divide(x, y))
        .when((x == 0) | F.isnan(x), F.lit(math.nan))
        .when(x > 0, F.lit(math.inf))
        .otherwise(F.lit(-math.inf))
    )


def ratio(x: Column | str, y: Column | str) -> Column:
    """x / y as doubles for a displayed figure: null where the denominator is 0."""
    return F.try_divide(_col(x).cast("double"), _col(y).cast("double"))


def is_known(c: Column | str) -> Column:
    """Neither null nor NaN (infinities count as known)."""
    c = _col(c)
    return c.isNotNull() & ~F.isnan(c)


def is_finite(c: Column | str) -> Column:
    c = _col(c)
    return is_known(c) & (F.abs(c) != F.lit(math.inf))


def or_zero(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(0))


def not_in(c: Column | str, values: Iterable, keep_null: bool) -> Column:
    """Exclusion list. SQL drops null rows (``keep_null=False``); a local frame filter keeps them."""
    c, values = _col(c), list(values)
    if not values:
        return F.lit(True) if keep_null else c.isNotNull()
    return c.isNull() | ~c.isin(values) if keep_null else ~c.isin(values)


def to_int(c: Column | str) -> Column:
    """Text to integer; text that is no number becomes null instead of failing the job."""
    return _col(c).try_cast("int")


# --- dates ---

def days_between(start: Column | str, end: Column | str) -> Column:
    return F.datediff(_col(end), _col(start))


def plus_days(c: Column | str, days: int) -> Column:
    return F.date_add(_col(c), days)


def iso_week(c: Column | str) -> Column:
    return F.weekofyear(_col(c))


def day_of(c: Column | str) -> Column:
    return F.to_date(_col(c))


def timestamp_of(text: Column | str) -> Column:
    return F.to_timestamp_ntz(_col(text))


def date_in_year(year: Column | str, month_day: str) -> Column:
    """``month_day`` is text such as ``-04-20``."""
    return F.to_date(F.concat(_col(year).cast("string"), F.lit(month_day)))


def move_to_year(c: Column | str, year: int) -> Column:
    """Same month and day in another year. ``year`` must be a leap year, so that 29 February has a place."""
    if not (year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)):
        raise ValueError(f"{year} is not a leap year")
    return F.to_date(F.concat(F.lit(str(year)), F.substring(_col(c).cast("string"), 5, 6)))


def season_label(ts: Column | str, first: int, last: int, other: int) -> Column:
    """Calendar year of a timestamp inside [first, last], else ``other``."""
    y = F.year(_col(ts))
    return F.when(y.between(first, last), y).otherwise(F.lit(other))


# --- statistics ---

def normal_pdf(x: Column | str, mean: Column | str, sd: Column | str) -> Column:
    x, mean, sd = _col(x), _col(mean), _col(sd)
    z = F.try_divide(x - mean, sd)
    return F.try_divide(F.exp(-z * z / 2), sd * math.sqrt(2 * math.pi))


def _within(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def log_gamma(x: Column | str) -> Column:
    """ln of the gamma function for x > 0: Stirling's series twelve steps further up, which is exact to a double there."""
    x = _col(x).cast("double")
    steps = F.lit(0.0)
    for k in range(12):
        steps = steps + F.log(x + k)
    y = x + 12
    series = F.lit(0.0)
    for power, divisor in ((1, 12), (3, -360), (5, 1260), (7, -1680), (9, 1188)):
        series = series + 1 / (divisor * F.pow(y, F.lit(float(power))))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - steps


def _beta_fraction(x: Column, a: Column, b: Column, steps: int) -> Column:
    """The continued fraction of the incomplete beta function, by the method of Lentz."""
    tiny = 1e-300
    lifted = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    def step(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        half = F.struct((1 / lifted(1 + even * state["d"])).alias("d"), lifted(1 + even / state["c"]).alias("c"), state["h"].alias("h"))
        return _within(half, lambda s: _within(
            F.struct((1 / lifted(1 + odd * s["d"])).alias("d"), lifted(1 + odd / s["c"]).alias("c"), (s["h"] * s["d"] * s["c"]).alias("h")),
            lambda t: F.struct(t["d"].alias("d"), t["c"].alias("c"), (t["h"] * t["d"] * t["c"]).alias("h"))))

    first = 1 / lifted(1 - (a + b) * x / (a + 1))
    start = F.struct(first.alias("d"), F.lit(1.0).alias("c"), first.alias("h"))
    places = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda m: m.cast("double"))
    return F.aggregate(places, start, step, lambda s: s["h"])


def incomplete_beta(x: Column | str, a: Column | str, b: Column | str, steps: int = 100) -> Column:
    """The regularised incomplete beta function I_x(a, b), from the side on which its fraction converges fast."""
    values = F.struct(_col(x).cast("double").alias("x"), _col(a).cast("double").alias("a"), _col(b).cast("double").alias("b"))

    def one_side(p: Column) -> Column:
        front = F.exp(p["a"] * F.log(p["x"]) + p["b"] * F.log(1 - p["x"]) + log_gamma(p["a"] + p["b"]) - log_gamma(p["a"]) - log_gamma(p["b"]))
        return front * _beta_fraction(p["x"], p["a"], p["b"], steps) / p["a"]

    def turned(p: Column) -> Column:
        over = p["x"] > (p["a"] + 1) / (p["a"] + p["b"] + 2)
        near = F.struct(
            F.when(over, 1 - p["x"]).otherwise(p["x"]).alias("x"), F.when(over, p["b"]).otherwise(p["a"]).alias("a"),
            F.when(over, p["a"]).otherwise(p["b"]).alias("b"), over.alias("over"))
        inside = lambda q: F.when((q["x"] <= 0) | (q["x"] >= 1), F.when(q["x"] <= 0, 0.0).otherwise(1.0)).otherwise(one_side(q))
        return _within(near, lambda q: F.when(q["over"], 1 - inside(q)).otherwise(inside(q)))

    return _within(values, turned)


#: Degrees of freedom from which the series in 1/df alone is exact enough.
SERIES_FROM = 400


def t_quantile(df: Column | str, level: float) -> Column:
    """Quantile of Student's t at ``level`` (between one half and one); null without degrees of freedom.

    The asymptotic series in 1/df (Abramowitz and Stegun 26.7.5) from ``SERIES_FROM`` degrees of freedom on. Below, the upper
    tail is half the incomplete beta function of df / (df + t^2), and is solved for t by Newton's steps on the logarithms
    of both, in which the tail is nearly a line; one and two degrees of freedom have closed forms.
    """
    if not 0.5 < level < 1:
        raise ValueError(f"level must be between one half and one, not {level!r}")
    z, tail = NormalDist().inv_cdf(level), 1 - level
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )

    def series(v: Column) -> Column:
        q = F.lit(z)
        for power, term in enumerate(terms, start=1):
            q = q + F.lit(term) / F.pow(v, F.lit(float(power)))
        return q

    def newton(v: Column) -> Column:
        scale = log_gamma((v + 1) / 2) - log_gamma(v / 2) - 0.5 * F.log(math.pi * v)

        def step(t: Column, _: Column) -> Column:
            above = _within(F.struct(t.alias("t"), (incomplete_beta(v / (v + t * t), v / 2, F.lit(0.5)) / 2).alias("p")), lambda s: s)
            density = lambda s: F.exp(scale - (v + 1) / 2 * F.log(1 + s["t"] * s["t"] / v))
            return _within(above, lambda s: s["t"] * F.exp(F.log(s["p"] / tail) * s["p"] / (s["t"] * density(s))))

        return F.aggregate(F.array_repeat(F.lit(0), 9), series(v), step)

    v = _col(df).cast("double")
    return F.when(v == 1, math.tan(math.pi * (level - 0.5))).when(v == 2, (2 * level - 1) * math.sqrt(1 / (2 * level * tail))).when(
        v >= SERIES_FROM, series(v)).when(v > 0, newton(v))


# --- display text, for sinks only ---

def percent_text(c: Column | str, digits: int = 1) -> Column:
    return F.when(_col(c).isNotNull(), F.format_string(f"%.{digits}f%%", _col(c).cast("double") * 100))


def round_half_even(c: Column | str, digits: int) -> Column:
    """Rounding of a displayed figure; ties go to the even digit."""
    return F.bround(_col(c), digits)


def thousands_text(c: Column | str) -> Column:
    return F.format_number(_col(c), 0)


def long_date_text(c: Column | str) -> Column:
    return F.date_format(_col(c), "dd MMMM yyyy")
