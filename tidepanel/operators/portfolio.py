"""Replays of candidates and statistics over many daily streams (task, model, attempt, date, daily_ret)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_corr, safe_div
from .backtest import daily_sharpe

STREAM = ["task", "model", "attempt"]


def unit_vol(streams: DataFrame) -> DataFrame:
    """Daily returns scaled to unit sample volatility per stream (0 for a constant stream)."""
    s = F.stddev_samp("daily_ret").over(Window.partitionBy(*STREAM))
    return streams.withColumn("unit_ret", safe_div("daily_ret", F.when(s > 0, s), 0.0))


def portfolio_curve(streams: DataFrame) -> DataFrame:
    """Mean scaled return per model, attempt and date, and its running sum."""
    per = unit_vol(streams).groupBy("model", "attempt", "date").agg(F.avg("unit_ret").alias("ret"))
    run = Window.partitionBy("model", "attempt").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("pnl", F.sum("ret").over(run))


def portfolio_sharpe(streams: DataFrame) -> DataFrame:
    return daily_sharpe(portfolio_curve(streams), 365.0, "ret", "model", "attempt")


def pooled_sharpe(streams: DataFrame) -> DataFrame:
    return daily_sharpe(unit_vol(streams), 365.0, "unit_ret", "model", "attempt")


def task_corr(streams: DataFrame) -> DataFrame:
    """Correlation of tasks' daily means on shared dates, each pair once."""
    per = unit_vol(streams).groupBy("task", "date").agg(F.avg("unit_ret").alias("r"))
    a, b = per.select("date", F.col("task").alias("task_a"), F.col("r").alias("x")), per.select("date", F.col("task").alias("task_b"), F.col("r").alias("y"))
    return a.join(b, "date").where("task_a < task_b").groupBy("task_a", "task_b").agg(safe_corr("x", "y", 0.0).alias("corr"), F.count(F.lit(1)).alias("n"))


def offdiag_corr(streams: DataFrame) -> DataFrame:
    return task_corr(streams).agg(F.avg("corr").alias("offdiag_corr"), F.count(F.lit(1)).alias("pairs"))


def factor_corr(streams: DataFrame, factor: DataFrame) -> DataFrame:
    """Correlation of each task's daily mean with a factor's daily returns."""
    per = unit_vol(streams).groupBy("task", "date").agg(F.avg("unit_ret").alias("r"))
    return per.join(factor.select("date", F.col("daily_ret").alias("f")), "date").groupBy("task").agg(safe_corr("r", "f", 0.0).alias("factor_corr"), F.count(F.lit(1)).alias("n"))


def attempt_corr(streams: DataFrame) -> DataFrame:
    """Correlation of a stream with the next attempt's on shared dates."""
    nxt = streams.select("task", "model", (F.col("attempt") - 1).alias("attempt"), "date", F.col("daily_ret").alias("later"))
    return streams.join(nxt, [*STREAM, "date"]).groupBy(*STREAM).agg(safe_corr("daily_ret", "later", 0.0).alias("corr"), F.count(F.lit(1)).alias("n"))


def sharpe_scatter(pairs: DataFrame, limit: float = 5.0) -> DataFrame:
    """One row: correlation of in-sample and out-of-sample Sharpe within the limit, and its t statistic."""
    x, y = (F.least(F.greatest(c, F.lit(-limit)), F.lit(limit)) for c in ("is_sharpe", "oos_sharpe"))
    r = pairs.agg(safe_corr(x, y, 0.0).alias("r"), F.count(F.lit(1)).alias("n"))
    return r.withColumn("t", safe_div(F.col("r") * F.sqrt((F.col("n") - 2).cast("double")), F.sqrt(F.greatest(1 - F.col("r") ** 2, F.lit(0.0))), 0.0))


def gate_exclusion(streams: DataFrame, gates: DataFrame) -> DataFrame:
    """Streams of tasks and models whose latest gated attempt did not fail."""
    last = gates.groupBy("task", "model").agg(F.max_by("status", "attempt").alias("status"))
    return streams.join(last.where("status = 'failed'"), ["task", "model"], "left_anti")


def replay(manifest: list[dict], score: Callable[[dict], DataFrame], limit: int | None = None) -> tuple[DataFrame | None, list[dict]]:
    """Daily streams of all candidates with their context columns, and a status per candidate; failures are recorded."""
    frames, status = [], []
    for row in manifest[:limit]:
        try:
            daily = score(row)
            context = {k: v for k, v in row.items() if k in ("task_name", "trial_id", "family_name", "model_name", "repeat_idx", "check_num")}
            frames.append(daily.withColumns({k: F.lit(v) for k, v in context.items()}))
            status.append(row | {"status": "completed"})
        except Exception as e:  # recorded, the batch goes on
            status.append(row | {"status": "failed", "error": str(e)[:500]})
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None), status


def code_path(experiment: str, row: dict) -> Path:
    for key in ("code_path", "source_path", "relative_path"):
        if row.get(key):
            p = Path(row[key])
            return p if p.is_absolute() else Path(experiment) / p
    raise ValueError("no code path in the manifest row")
