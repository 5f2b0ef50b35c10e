"""What an evaluation leaves behind: feature views with their metadata, signals, daily PnL, scored rows.

All are Parquet folders written aside and put in place when their job has ended well; counts come from the same job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import KEYS
from ..operators import backtest as B
from ..operators import features as X
from .panel import write_json
from .store import write_frame


def _counts() -> dict[str, Column]:
    count = lambda c: F.count(F.when(c, F.lit(1)))
    return {"train_rows": count(~F.col(X.FLAG)), "hidden_rows": count(F.col(X.FLAG)), "prediction_rows": count(F.col(X.FLAG))}


def _facts(rows: DataFrame, mode: str) -> dict:
    return {"return_mode": mode, "safe_return_lags": list(X.LAGS), "return_columns": X.return_columns(rows), "feature_columns": rows.columns}


def write_view(train: DataFrame | None, hidden: DataFrame, path: str, mode: str = "null", metadata: str | None = None) -> dict:
    """Writes the feature view of both periods; gives back, and writes as JSON where asked, its nine keys of metadata."""
    rows = X.view(train, hidden, mode)
    seen = write_frame(rows, path, **_counts())
    out = _facts(rows, mode) | {k: v for k, v in seen.items() if k != "rows"} | {"feature_rows": seen["rows"], "feature_path": path}
    if metadata:
        write_json(hidden.sparkSession, metadata, out)
    return out


def view_report(train: DataFrame | None, hidden: DataFrame, mode: str = "null") -> DataFrame:
    """One row: the metadata of a view without writing it, lists as comma-separated text."""
    rows = X.view(train, hidden, mode)
    text = {k: ",".join(map(str, v)) if isinstance(v, list) else v for k, v in _facts(rows, mode).items()}
    counted = rows.agg(*(c.alias(n) for n, c in _counts().items()), F.count(F.lit(1)).alias("feature_rows"))
    return counted.select(*(F.lit(v).alias(k) for k, v in text.items()), *counted.columns)


def write_signal(signal: DataFrame, path: str) -> int:
    """Writes keys and signal; gives back the number of rows."""
    return write_frame(signal.select(*KEYS, F.col("signal").cast("double").alias("signal")), path)["rows"]


def write_daily_pnl(bars: DataFrame, path: str, by: tuple[str, ...] = ()) -> int:
    """Writes the daily sums of a backtest's bars; gives back the number of days."""
    return write_frame(B.daily_pnl(bars, by), path)["rows"]


def write_debug(folder: str, bars: DataFrame | None, joined: DataFrame | None = None, debug: bool = False, with_returns: bool = True, daily_name: str = "daily_pnl.parquet", joined_name: str = "joined_signal_returns.parquet") -> dict[str, int]:
    """With ``debug``: daily PnL of the bars, and the rows that were scored unless ``with_returns`` is off. Names and rows of what was written."""
    out = {}
    if debug and bars is not None and "net_ret" in bars.columns:
        out[daily_name] = write_daily_pnl(bars, f"{folder.rstrip('/')}/{daily_name}")
    if debug and with_returns and joined is not None:
        out[joined_name] = write_frame(joined, f"{folder.rstrip('/')}/{joined_name}")["rows"]
    return out
