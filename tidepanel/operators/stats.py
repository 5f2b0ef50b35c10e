"""Statistics of a signal against returns, in long form. ``dialect`` is "engine" or "evaluator"."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS, NAME, TIME, avg_rank, is_finite, own, qcut_bucket, rank_quintile, safe_corr, safe_div

DECAY = {"engine": (1, 2, 3, 6, 12, 24), "evaluator": (1, 2, 4, 8, 24)}
LEAST = {"engine": 20, "evaluator": 100}


def with_next(panel: DataFrame, target: str = "residual_return", *keep: str) -> DataFrame:
    """Keys (and columns to keep) with the return of the same bar and of the ticker's next row."""
    return panel.select(*KEYS, *keep, F.col(target).alias("ret"), F.lead(target).over(own()).alias("ret_next"))


def aligned(right: DataFrame, left: DataFrame) -> DataFrame:
    """``right`` with its keys cast to the types that they have in ``left``."""
    want = {c: left.schema[c].dataType for c in KEYS if left.schema[c].dataType != right.schema[c].dataType}
    return right.withColumns({c: F.col(c).cast(t) for c, t in want.items()}) if want else right


def scored(signal: DataFrame, panel: DataFrame | None = None, target: str = "residual_return", by: tuple[str, ...] = ()) -> DataFrame:
    """signal, ret, ret_next: what most statistics read. A panel that has the signal as a column needs no join.

    Several candidates, told apart by the signal's ``by`` columns, share the panel's scan.
    """
    if panel is None:
        return with_next(signal, target, "signal")
    return aligned(signal, panel).select(*by, *KEYS, "signal").join(with_next(panel, target), KEYS)


def ic_per_bar(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    ok = is_finite("signal") & is_finite("ret_next")
    return rows.where(ok).groupBy(*by, TIME).agg(F.avg(F.col("signal") * F.col("ret_next")).alias("ic"), F.count(F.lit(1)).alias("n"))


def ic_summary(ic: DataFrame, checker: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    std = F.stddev_samp("ic") if checker else F.stddev_pop("ic")
    return ic.groupBy(*by).agg(F.avg("ic").alias("mean_ic"), std.alias("ic_std"), F.avg((F.col("ic") > 0).cast("double")).alias("ic_positive"), F.count(F.lit(1)).alias("n_timestamps"))


def ic_tstat(ic: DataFrame) -> DataFrame:
    s = F.stddev_samp("ic")
    return ic.agg(safe_div(F.avg("ic") * F.sqrt(F.count("ic").cast("double")), F.when(s > 0, s), 0.0).alias("ic_tstat"))


def return_corr(rows: DataFrame) -> DataFrame:
    ok = rows.where(is_finite("signal") & is_finite("ret"))
    return ok.agg(F.when(F.count(F.lit(1)) >= 10, safe_corr("signal", "ret", 0.0)).otherwise(0.0).alias("return_correlation"))


def autocorr(signal: DataFrame) -> DataFrame:
    rows = signal.withColumn("before", F.lag("signal").over(own()))
    return rows.agg(safe_corr("signal", "before", 0.0).alias("autocorrelation"))


def quantile_returns(rows: DataFrame, dialect: str = "engine", n: int = 5) -> DataFrame:
    """Mean next return per bucket of the bar."""
    ok = rows.where(is_finite("signal") & is_finite("ret_next"))
    bucket = rank_quintile("signal", n) if dialect == "engine" else qcut_bucket("signal", n)
    return ok.withColumn("bucket", bucket).groupBy("bucket").agg(F.avg("ret_next").alias("mean_return"), F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    ranked = df.select(*by, avg_rank(x, *by).alias("rx"), avg_rank(y, *by).alias("ry"))
    return ranked.groupBy(*by).agg(safe_corr("rx", "ry", 0.0).alias("spearman"), F.count(F.lit(1)).alias("n"))


def quantile_spread(rows: DataFrame, dialect: str = "engine", n: int = 5) -> DataFrame:
    """One row: top less bottom bucket and rank correlation of bucket and mean (0 below the least number of rows)."""
    by = quantile_returns(rows, dialect, n)
    total = F.sum("n") >= LEAST[dialect]
    top = F.max_by("mean_return", "bucket") if dialect == "engine" else F.max(F.when(F.col("bucket") == n - 1, F.col("mean_return")))
    low = F.min_by("mean_return", "bucket") if dialect == "engine" else F.max(F.when(F.col("bucket") == 0, F.col("mean_return")))
    ranked = by.select("bucket", "mean_return", "n", avg_rank("bucket", F.lit(0)).alias("rx"), avg_rank("mean_return", F.lit(0)).alias("ry"))
    return ranked.agg(F.when(total, F.coalesce(top - low, F.lit(0.0))).otherwise(0.0).alias("spread"), F.when(total, safe_corr("rx", "ry", 0.0)).otherwise(0.0).alias("monotonicity"))


def with_ahead(panel: DataFrame, dialect: str = "engine", target: str = "residual_return", *keep: str) -> DataFrame:
    """Keys (and columns to keep) with the target so many rows ahead as h<rows>."""
    return panel.select(*KEYS, *keep, *(F.lead(target, h).over(own()).alias(f"h{h}") for h in DECAY[dialect]))


def decay_of(rows: DataFrame, dialect: str = "engine") -> DataFrame:
    """horizon, ic from rows (bar, signal, h<rows>): all horizons in one aggregate per bar. One without any pair is left out."""
    hs = DECAY[dialect]
    pair = {h: F.when(is_finite("signal") & is_finite(f"h{h}"), F.col("signal") * F.col(f"h{h}")) for h in hs}
    per = rows.groupBy(TIME).agg(*(F.avg(v).alias(f"ic{h}") for h, v in pair.items()), *(F.count(v).alias(f"n{h}") for h, v in pair.items()))
    total = per.agg(*(F.avg(f"ic{h}").alias(f"ic{h}") for h in hs), *(F.sum(f"n{h}").alias(f"n{h}") for h in hs))
    each = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"ic{h}").alias("ic"), F.col(f"n{h}").alias("n")) for h in hs)))
    least = 1 if dialect == "engine" else LEAST[dialect]
    return total.select(each.alias("x")).where("x.n > 0").select("x.horizon", F.when(F.col("x.n") >= least, F.col("x.ic")).otherwise(0.0).alias("ic"))


def ic_decay(signal: DataFrame, panel: DataFrame, dialect: str = "engine", target: str = "residual_return") -> DataFrame:
    """horizon, ic: mean over bars of the bar's mean of signal times the return so many rows ahead."""
    return decay_of(signal.select(*KEYS, "signal").join(with_ahead(panel, dialect, target), KEYS), dialect)


def dk_tstat(rows: DataFrame, dialect: str = "engine") -> DataFrame:
    """One row: t statistic of a pooled regression on the signal, robust to correlation across and along bars.

    The rows are read once, for moments per bar; all else happens on bar rows. With the Bartlett kernel of
    ``width`` lags the long-run variance of the scores is the mean square of their sums over ``width + 1`` bars,
    so each running sum is dealt to its own place and, negated, ``width + 1`` places on. Below the least number
    of rows it is 0. Where no slope exists (constant signal, one bar) the engine gives the IC's t statistic.
    """
    y = "ret" if dialect == "engine" else "ret_next"
    ok = is_finite("signal") & is_finite(y)
    x, y = F.when(ok, F.col("signal")), F.when(ok, F.col(y))
    ic = F.when(is_finite("signal") & is_finite("ret_next"), F.col("signal") * F.col("ret_next"))
    per = rows.groupBy(TIME).agg(
        F.count(x).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.covar_pop(x, y).alias("cxy"),
        F.min(x).alias("low"), F.max(x).alias("high"), F.avg(ic).alias("ic"),
    )
    every = Window.partitionBy(F.lit(0))
    spread = F.stddev_samp("ic").over(every)
    by_ic = safe_div(F.avg("ic").over(every) * F.sqrt(F.count("ic").over(every).cast("double")), F.when(spread > 0, spread), 0.0)
    per = per.withColumn("by_ic", by_ic).where("n > 0").withColumn("rows", F.sum("n").over(every)).withColumn("bars", F.count(F.lit(1)).over(every))
    mean = lambda c: F.sum(F.col("n") * F.col(c)).over(every) / F.col("rows")
    per = per.withColumn("varies", F.min("low").over(every) < F.max("high").over(every)).withColumns({"dx": F.col("mx") - mean("mx"), "dy": F.col("my") - mean("my")})
    xx, xy = F.col("n") * (F.col("vx") + F.col("dx") * F.col("dx")), F.col("n") * (F.col("cxy") + F.col("dx") * F.col("dy"))
    per = per.withColumns({"xx": xx, "xy": xy}).withColumn("sxx", F.sum("xx").over(every))
    per = per.withColumn("slope", safe_div(F.sum("xy").over(every), F.when(F.col("varies"), F.col("sxx"))))
    run = Window.orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    width = F.ceil(F.cbrt(F.col("bars")) - 1e-9)
    per = per.select("by_ic", "rows", "bars", "sxx", "slope", width.alias("width"), F.count(F.lit(1)).over(run).alias("i"), F.sum(F.col("xy") - F.col("slope") * F.col("xx")).over(run).alias("c"))
    same = ("by_ic", "rows", "bars", "sxx", "slope", "width")
    cells = per.select(*same, F.explode(F.array(F.struct("i", "c"), F.struct((F.col("i") + F.col("width") + 1).alias("i"), (-F.col("c")).alias("c")))).alias("x"))
    sums = cells.groupBy("x.i").agg(F.sum("x.c").alias("v"), *(F.max(c).alias(c) for c in same))
    one = sums.agg(F.sum(F.col("v") * F.col("v")).alias("vv"), *(F.max(c).alias(c) for c in same))
    var = F.col("vv") / (F.col("width") + 1) / F.pow("sxx", F.lit(2)) * F.try_divide("bars", F.col("bars") - 1) * ((F.col("rows") - 1) / (F.col("rows") - 2))
    t = F.when(F.col("slope").isNull() | (F.col("bars") < 2), F.col("by_ic") if dialect == "engine" else F.lit(0.0)).otherwise(safe_div("slope", F.when(var > 0, F.sqrt(var)), 0.0))
    return one.select(F.when(F.col("rows") >= LEAST[dialect], t).otherwise(0.0).alias("dk_tstat"))


def calibration(rows: DataFrame, n: int = 10) -> DataFrame:
    """Per decile of the bar: mean next return, rows and centre; no rows below a hundred."""
    by = quantile_returns(rows, "evaluator", n)
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return by.where("n > 0").withColumn("total", total).where("total >= 100").select("bucket", ((F.col("bucket") + 0.5) / n * 100).alias("center"), F.col("mean_return").alias("avg_return"), F.col("n").alias("count"))


def calibration_fit(curve: DataFrame) -> DataFrame:
    return curve.agg(F.when(F.count(F.lit(1)) >= 3, F.regr_slope("avg_return", "center")).alias("slope"), F.when(F.count(F.lit(1)) >= 3, F.regr_intercept("avg_return", "center")).alias("intercept"))


def rank_ic(rows: DataFrame) -> DataFrame:
    """Rank correlation of signal and same-bar return for bars of three names or more."""
    ok = rows.where(is_finite("signal") & is_finite("ret"))
    return spearman(ok, "signal", "ret", TIME).where("n >= 3").select(TIME, F.col("spearman").alias("rank_ic"), "n")


def coverage(signal: DataFrame, panel: DataFrame) -> DataFrame:
    """Signal rows against bars times symbols of the signal, and the share of the panel's bars it has."""
    s = signal.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(TIME).alias("bars"), F.countDistinct(NAME).alias("names"))
    p = panel.agg(F.countDistinct(TIME).alias("all_bars")).first()[0]
    return s.select(safe_div("rows", F.col("bars") * F.col("names"), 0.0).alias("coverage"), safe_div("bars", F.lit(p), 0.0).alias("bar_coverage"))


def names_per_bar(signal: DataFrame) -> DataFrame:
    per = signal.groupBy(TIME).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.avg("n").alias("names_per_bar"), F.min("n").alias("least"), F.max("n").alias("most"))


def rolling_ic(ic: DataFrame, window: int = 168, trimmed: bool = False) -> DataFrame:
    """Trailing mean of the bars' IC; rows of bars only, so one window holds them.

    ``trimmed`` leaves out the first bars, at most ``window`` of them or a quarter of all, whose means are of few bars.
    """
    out = ic.withColumn("rolling_ic", F.avg("ic").over(Window.orderBy(TIME).rowsBetween(-(window - 1), 0)))
    if not trimmed:
        return out
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    place = F.row_number().over(Window.orderBy(TIME))
    return out.withColumns({"_n": n, "_place": place}).where(F.col("_place") > F.least(F.lit(window), F.floor(F.col("_n") / 4))).drop("_n", "_place")
