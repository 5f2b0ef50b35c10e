"""Saved candidates replayed on hidden data: all snapshots of a checker log share one view and one read of the panel.

A snapshot is a text ``code_<number>.py`` with a function ``build_signal(view)`` that returns a DataFrame of
timestamp_agg, ticker and signal, or a column to be read as the signal. Texts come through Spark's reader, from any store.
Candidates are an axis of the data: their signals are one long frame with the check's number, normalised, joined with
returns, backtested and summed once for all of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import KEYS
from . import backtest as B
from . import features as X
from . import stats as G

Candidate = Callable[[DataFrame], DataFrame | Column]
BY = ("check_num",)
RESULT = "check_num int, status string, reason string, signal_rows long, mean_ic double, hidden_oos_sharpe double, hidden_oos_max_drawdown double"


def read(spark: SparkSession, folder: str) -> list[tuple[int, str, str]]:
    """(number, path, text) of the snapshots in a folder, by number; none where there is no folder. Other files are passed over."""
    try:
        files = spark.read.option("pathGlobFilter", "code_*.py").text(folder, wholetext=True).select("_metadata.file_path", "value").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    found = [(int(m[1]), r["file_path"], r["value"]) for r in files if (m := re.search(r"code_(\d+)\.py$", r["file_path"]))]
    return sorted(found)


def load(text: str, name: str = "snapshot") -> Candidate:
    """``build_signal`` of a snapshot's text. The text is run: it must come from a source that is trusted."""
    space: dict = {"__name__": name}
    exec(compile(text, name, "exec"), space)  # noqa: S102
    if not callable(space.get("build_signal")):
        raise AttributeError("the snapshot has no build_signal")
    return space["build_signal"]


def _signal(candidate: Candidate, view: DataFrame) -> DataFrame:
    made = candidate(view)
    if isinstance(made, Column):
        made = view.withColumn("signal", made)
    if missing := sorted({*KEYS, "signal"} - set(made.columns)):
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return made.select(*KEYS, F.col("signal").cast("double").alias("signal"))


def replay(train: DataFrame | None, hidden: DataFrame, candidates: dict[int, Candidate | str], target: str = "residual_return", per_year: float = 365.0) -> tuple[DataFrame, DataFrame]:
    """(results, daily PnL) of candidates by check number: functions, or texts that are scanned and run.

    Results have one row per check, columns as ``RESULT``. status: completed, policy_violation (a text breaks a pattern),
    invalid_schema (columns are missing), error (building the signal failed, or there are fewer than two bars), or
    invalid_signal (no row in the prediction period). A check that fails leaves the others as they are.
    """
    spark = hidden.sparkSession
    view = X.view(train, hidden)
    frames, status = [], []
    for number, candidate in sorted(candidates.items()):
        if isinstance(candidate, str) and (broken := X.policy_violations(candidate)):
            status.append((number, "policy_violation", "; ".join(broken)))
            continue
        try:
            built = _signal(load(candidate, f"check_{number:03d}") if isinstance(candidate, str) else candidate, view)
        except KeyError as e:
            status.append((number, "invalid_schema", str(e.args[0])))
        except Exception as e:  # a candidate's own error is its result
            status.append((number, "error", str(e)[:500]))
        else:
            status.append((number, None, None))
            frames.append(built.withColumn("check_num", F.lit(number)))
    seen = spark.createDataFrame(status, "check_num int, status string, reason string")
    if not frames:
        none = spark.createDataFrame([], "check_num int, date date, daily_ret double")
        return seen.select("*", F.lit(0).cast("long").alias("signal_rows"), *(F.lit(None).cast("double").alias(c) for c in ("mean_ic", "hidden_oos_sharpe", "hidden_oos_max_drawdown"))), none
    long = reduce(lambda a, b: a.unionByName(b), frames)
    keys = view.where(X.FLAG).select(*KEYS).distinct()
    long = G.aligned(long, hidden).join(keys, KEYS)
    signal = X.normalised(long, by=BY)
    bars = B.backtest_bars(signal, hidden, target, by=BY)
    daily = B.daily_pnl(bars, BY)
    rows = long.groupBy(*BY).agg(F.count(F.lit(1)).alias("signal_rows"))
    ic = G.ic_summary(G.ic_per_bar(G.scored(signal, hidden, target, BY), BY), by=BY).select(*BY, "mean_ic")
    low = B.drawdown(bars, BY).groupBy(*BY).agg(F.min("drawdown").alias("hidden_oos_max_drawdown"))
    sharpe = B.daily_sharpe(daily, per_year, "daily_ret", *BY).withColumnRenamed("sharpe", "hidden_oos_sharpe")
    out = seen
    for part in (rows, ic, sharpe, low):
        out = out.join(part, list(BY), "left")
    found, done = F.coalesce("signal_rows", F.lit(0)), F.col("hidden_oos_sharpe").isNotNull()
    state = F.when(F.col("status").isNotNull(), F.col("status")).when(found == 0, "invalid_signal").when(done, "completed").otherwise("error")
    why = F.when(F.col("status").isNotNull(), F.col("reason")).when(found == 0, "no prediction-period rows").when(~done, "a backtest needs two bars")
    return out.select("check_num", state.alias("status"), why.alias("reason"), found.alias("signal_rows"), "mean_ic", "hidden_oos_sharpe", "hidden_oos_max_drawdown"), daily


def replay_folder(train: DataFrame | None, hidden: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """``replay`` of a checker log's snapshots."""
    return replay(train, hidden, {n: text for n, _, text in read(hidden.sparkSession, folder)})
