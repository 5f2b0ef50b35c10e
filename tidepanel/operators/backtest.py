"""Backtest in long form with a delay of one bar.

The dense (bar, ticker) grid is never built: a cell matters only where the ticker has a row at the bar
or had one at the bar before, so every row is dealt to its own and the next bar and the two meet there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EPS, KEYS, NAME, TIME, is_finite, safe_div
from .stats import aligned

HOURS = 8760.0


def _enough(bars: str) -> Column:
    """True, or an error below two bars."""
    return F.when(F.col(bars) >= 2, F.lit(True)).otherwise(F.raise_error(F.lit("a backtest needs two bars")).cast("boolean"))


def first_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each key, the first in ``order`` (ties: any of them); nothing but the earliest row so far is kept."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_x")).select(*keys, "_x.*")


def backtest_bars(
    signal: DataFrame, panel: DataFrame | None = None, target: str = "residual_return", max_gross: float = 2.0, dialect: str = "engine",
    by: tuple[str, ...] = (), order: str | None = None,
) -> DataFrame:
    """One row per bar: gross_returns, net_ret, turnover, cost, funding_pnl, gross_leverage, equity_curve.

    A panel that has the signal as a column needs no join. A single bar raises an error; without any row there is no bar,
    and ``metrics`` raises. With ``by`` (columns of the signal, such as a candidate's name) each group is a backtest of
    its own, all over one read of the panel; groups of fewer than two bars are left out. Rows of the same keys are summed,
    or, with ``order`` (a column of the rows), the first one counts.
    """
    by, extra = list(by), [order] if order else []
    if panel is None:
        rows = signal.select(*by, *KEYS, "signal", F.col(target).alias("r"), *extra)
    else:
        own = [c for c in extra if c in signal.columns]
        rows = aligned(signal, panel).select(*by, *KEYS, "signal", *own).join(panel.select(*KEYS, F.col(target).alias("r"), *(c for c in extra if c not in own)), KEYS)
    if order:
        rows = first_rows(rows, [*by, *KEYS], order)
    if dialect == "engine":
        rows = rows.where(is_finite("signal") & is_finite("r"))
    rows = rows.select(*by, *KEYS, F.coalesce("signal", F.lit(0.0)).alias("w"), F.coalesce("r", F.lit(0.0)).alias("r"))
    gross = F.sum(F.abs("w")).over(Window.partitionBy(*by, TIME))
    rows = rows.withColumn("w", F.col("w") * F.when(gross > max_gross, max_gross / F.greatest(gross, F.lit(EPS))).otherwise(1.0))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    bars = rows.select(*by, TIME).distinct().withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(TIME)))
    bars = bars.withColumn("bars", F.count(F.lit(1)).over(group)).where(F.col("bars") >= 2 if by else _enough("bars")).drop("bars")
    numbered = rows.join(bars, [*by, TIME])
    none = F.lit(None).cast("double")
    cells = numbered.select(*by, NAME, F.explode(F.array(F.struct("i", F.col("w").alias("w"), "r", F.lit(0.0).alias("w0")), F.struct((F.col("i") + 1).alias("i"), F.lit(0.0).alias("w"), none.alias("r"), F.col("w").alias("w0")))).alias("x"))
    cells = cells.groupBy(*by, NAME, "x.i").agg(F.sum("x.w").alias("w"), F.coalesce(F.max("x.r"), F.lit(0.0)).alias("r"), F.sum("x.w0").alias("w0"))
    at = Window.partitionBy(*by, "i")
    cells = cells.withColumn("port", F.sum(F.col("w0") * F.col("r")).over(at))
    end = F.col("w0") * (1 + F.col("r")) / F.greatest(1 + F.col("port"), F.lit(EPS))
    per = cells.groupBy(*by, "i").agg(F.max("port").alias("gross_returns"), F.sum(F.abs(F.col("w") - end)).alias("traded"), F.sum(F.abs("w0")).alias("gross_leverage"))
    per = per.join(bars, [*by, "i"])  # the bar after the last one goes
    run = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return per.select(
        *by, TIME, "gross_returns", F.col("gross_returns").alias("net_ret"), F.when(F.col("i") == 1, 0.0).otherwise(F.col("traded") / 2).alias("turnover"),
        F.lit(0.0).alias("cost"), F.lit(0.0).alias("funding_pnl"), "gross_leverage", (1 + F.sum("gross_returns").over(run)).alias("equity_curve"),
    )


def drawdown(bars: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    peak = F.max("equity_curve").over(Window.partitionBy(*by).orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumn("drawdown", F.col("equity_curve") / F.greatest(peak, F.lit(EPS)) - 1)


def metrics(bars: DataFrame, per_year: float = HOURS, by: tuple[str, ...] = ()) -> DataFrame:
    """One row of performance figures (hourly bars by default), or one per group; fewer than two bars raise an error."""
    n, end = F.count(F.lit(1)), F.max_by("equity_curve", TIME)
    vol = F.stddev_samp("net_ret")
    sharpe = lambda c: safe_div(F.avg(c) * per_year**0.5, F.when(F.stddev_samp(c) > 0, F.stddev_samp(c)), 0.0)
    return drawdown(bars, by).groupBy(*by).agg(
        n.alias("n_timestamps"), (end - 1).alias("total_return"), F.when(end > 0, F.pow(end, per_year / n) - 1).otherwise(0.0).alias("CAGR"),
        (vol * per_year**0.5).alias("volatility"), sharpe("net_ret").alias("sharpe_net"), sharpe("gross_returns").alias("sharpe_gross"), F.min("drawdown").alias("max_drawdown"),
        (F.avg("turnover") * per_year).alias("turnover_ann"), (F.avg("cost") * 1e4).alias("cost_bps"), F.avg("gross_leverage").alias("gross_leverage"),
    ).where(_enough("n_timestamps"))


def daily_pnl(bars: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return bars.groupBy(*by, F.to_date(TIME).alias("date")).agg(F.sum("net_ret").alias("daily_ret"))


def daily_sharpe(daily: DataFrame, per_year: float = 365.0, column: str = "daily_ret", *by: str) -> DataFrame:
    s = F.stddev_samp(column)
    out = F.when(F.count(F.lit(1)) >= 2, safe_div(F.avg(column) * per_year**0.5, F.when(s > 0, s), 0.0)).otherwise(0.0)
    return daily.groupBy(*by).agg(out.alias("sharpe"))


def compounded(daily: DataFrame) -> DataFrame:
    """Compounded equity of daily returns (above -1) and its drawdown."""
    run = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = daily.withColumn("equity", F.exp(F.sum(F.log1p("daily_ret")).over(run)))
    peak = F.max("equity").over(run)
    return out.withColumn("drawdown", (F.col("equity") - peak) / (peak + EPS))
