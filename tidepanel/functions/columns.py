"""Column expressions shared by the panel operators; all stay inside Spark's own functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-8
TIME, NAME = "timestamp_agg", "ticker"
KEYS = [TIME, NAME]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bar():
    """Window over the cross-section of a bar."""
    return Window.partitionBy(TIME)


def own(last: int | None = None, upto: int = 0):
    """Window over a ticker in time order; with ``last`` the rows from ``last`` back to ``upto`` (0: this one)."""
    w = Window.partitionBy(NAME).orderBy(TIME)
    return w if last is None else w.rowsBetween(-last, upto)


def is_finite(c: Column | str) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def safe_div(a: Column | str, b: Column | str, default: float | None = None) -> Column:
    """a / b; ``default`` where b is zero or either side is missing."""
    out = F.try_divide(col(a).cast("double"), col(b).cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def clip(c: Column | str, low: float, high: float) -> Column:
    """Bounds for numbers; null and NaN pass (greatest and least would turn NaN into a bound)."""
    c = col(c)
    return F.when(F.isnan(c) | c.isNull(), c).otherwise(F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def no_nan(c: Column | str) -> Column:
    """NaN as null."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def zscore(c: Column | str, dialect: str = "engine", by: tuple[str, ...] = ()) -> Column:
    """Cross-sectional score within +-4; the engine dialect reads missing as 0, the evaluator keeps nulls."""
    c, w = col(c), Window.partitionBy(*by, TIME)
    z = (c - F.avg(c).over(w)) / F.greatest(F.stddev_samp(c).over(w), F.lit(EPS))
    z = F.when(F.isnan(z), F.lit(0.0)).otherwise(clip(z, -4.0, 4.0))
    return F.coalesce(z, F.lit(0.0)) if dialect == "engine" else z


def avg_rank(c: Column | str, *within: Column | str) -> Column:
    """Rank from 1 within the partition; ties share the mean of their ranks."""
    c = col(c)
    order = Window.partitionBy(*within).orderBy(c)
    return F.rank().over(order) + (F.count(F.lit(1)).over(Window.partitionBy(*within, c)) - 1) / 2


def rank_quintile(c: Column | str, n: int = 5) -> Column:
    count = F.count(F.lit(1)).over(bar())
    return F.least(F.greatest(F.floor((avg_rank(c, TIME) - 1) / count * n), F.lit(0)), F.lit(n - 1)).cast("int")


def qcut_bucket(c: str, n: int) -> Column:
    """Bucket of equal-probability, linearly interpolated, right-closed breaks of the bar."""
    breaks = F.expr(f"percentile({c}, array({', '.join(str(k / n) for k in range(1, n))})) over (partition by {TIME})")
    return F.aggregate(breaks, F.lit(0), lambda s, b: s + (F.col(c) > b).cast("int"))


def safe_corr(x: Column | str, y: Column | str, default: float | None = None) -> Column:
    """Pearson correlation as an aggregate, from centred second moments; a constant side gives ``default``."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return safe_div(F.covar_pop(x, y), F.when(spread > 1e-15, spread), default)


def with_row_index(df: DataFrame, name: str = "row") -> DataFrame:
    """``name``: place of every row, from 0, in order of ticker and time. Only the tickers' counts meet in one window."""
    before = F.sum("n").over(Window.orderBy(NAME).rowsBetween(Window.unboundedPreceding, -1))
    counts = df.groupBy(NAME).agg(F.count(F.lit(1)).alias("n")).select(F.col(NAME).alias("_name"), F.coalesce(before, F.lit(0)).alias("_before"))
    rows = df.withColumn(name, F.row_number().over(own()) - 1).join(counts, F.col(NAME).eqNullSafe(F.col("_name")))
    return rows.withColumn(name, F.col(name) + F.col("_before")).drop("_name", "_before")


def any_of(c: Column | str, values: list) -> Column:
    return reduce(lambda a, b: a | b, (col(c) == F.lit(v) for v in values), F.lit(False))


def closed_range(c: Column | str, start=None, end=None) -> Column:
    """start <= c <= end; a missing bound is open."""
    c = col(c)
    parts = [c >= F.lit(start)] * (start is not None) + [c <= F.lit(end)] * (end is not None)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def stripe_ordinal(c: Column | str, unit: str) -> Column:
    """Number of the calendar unit that a time falls into; weeks join the calendar year and the ISO week."""
    c = col(c)
    day = F.year(c) * 366 + F.dayofyear(c)
    return {
        "month": F.year(c) * 12 + F.month(c), "week": F.year(c) * 53 + F.weekofyear(c), "day": day, "hour": day * 24 + F.hour(c),
    }[unit].cast("long")


def lcg_noise(row: Column | str) -> Column:
    """Deterministic noise in [-0.25, 0.25) from a row number."""
    step = F.pmod(col(row).cast("long") * 1103515245 + 12345, F.lit(2_000_000))
    return (step / 1_000_000 - 1.0) * 0.25
