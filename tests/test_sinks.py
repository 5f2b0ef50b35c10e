"""Views, signals and debug frames as written, and their metadata."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import backtest, features, stats
from tidepanel.sources import sinks

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def halves(spark):
    rows = [(START + timedelta(hours=h), n, 0.001 * ((h * 5 + i) % 7 - 3), 100.0 + h) for h in range(96) for i, n in enumerate("ABC")]
    df = spark.createDataFrame(rows, "timestamp_agg timestamp, ticker string, residual_return double, close double")
    cut = START + timedelta(hours=60)
    return df.where(F.col("timestamp_agg") < cut), df.where(F.col("timestamp_agg") >= cut)


def test_view_and_metadata(spark, halves, tmp_path):
    train, hidden = halves
    made = sinks.write_view(train, hidden, str(tmp_path / "view"), "lagged", str(tmp_path / "view.json"))
    rows = spark.read.parquet(str(tmp_path / "view"))
    assert json.loads((tmp_path / "view.json").read_text()) == made
    assert set(made) == {"feature_path", "return_mode", "safe_return_lags", "train_rows", "hidden_rows", "feature_rows", "prediction_rows", "return_columns", "feature_columns"}
    assert (made["train_rows"], made["hidden_rows"], made["feature_rows"]) == (180, 108, 288) and made["feature_columns"] == rows.columns
    assert rows.exceptAll(features.view(train, hidden, "lagged")).count() == 0 and rows.count() == 288
    alone = sinks.view_report(None, hidden).first()
    assert (alone["train_rows"], alone["prediction_rows"], alone["return_columns"]) == (0, 108, "residual_return")


def test_signal_and_debug_frames(spark, halves, tmp_path):
    train, hidden = halves
    signal = features.view(train, hidden).where("is_prediction_period").withColumn("signal", -F.col("residual_return_lag1"))
    bars = backtest.backtest_bars(signal.select("timestamp_agg", "ticker", "signal"), hidden)
    assert sinks.write_signal(signal, str(tmp_path / "signal")) == 108
    assert spark.read.parquet(str(tmp_path / "signal")).columns == ["timestamp_agg", "ticker", "signal"]
    joined = stats.scored(signal.select("timestamp_agg", "ticker", "signal"), hidden)
    assert sinks.write_debug(str(tmp_path / "off"), bars, joined) == {} and not (tmp_path / "off").exists()
    assert sinks.write_debug(str(tmp_path / "on"), bars, joined, debug=True) == {"daily_pnl.parquet": 2, "joined_signal_returns.parquet": 108}
    assert sinks.write_debug(str(tmp_path / "part"), bars, joined, debug=True, with_returns=False) == {"daily_pnl.parquet": 2}
    got = {r["date"]: r["daily_ret"] for r in spark.read.parquet(str(tmp_path / "on/daily_pnl.parquet")).collect()}
    assert got == {r["date"]: r["daily_ret"] for r in backtest.daily_pnl(bars).collect()}
