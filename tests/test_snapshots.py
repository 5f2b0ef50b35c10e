"""Snapshot replay: all candidates at once equal each one alone; every failure has its status; duplicate keys."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import backtest, features, snapshots, stats

START = datetime(2024, 1, 1)
LAG = "from pyspark.sql import functions as F\n\ndef build_signal(view):\n    return view.withColumn('signal', {})\n"


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(START + timedelta(hours=h), n, 0.001 * ((h * 7 + i * 13) % 11 - 5), 100.0 + h) for h in range(120) for i, n in enumerate("ABCDE")]
    df = spark.createDataFrame(rows, "timestamp_agg timestamp, ticker string, residual_return double, close double")
    cut = START + timedelta(hours=60)
    return df.where(F.col("timestamp_agg") < cut).cache(), df.where(F.col("timestamp_agg") >= cut).cache()


def test_every_check_has_its_row(spark, panel, tmp_path):
    train, hidden = panel
    texts = {
        1: LAG.format("-F.col('residual_return_lag1')"), 2: LAG.format("F.col('residual_return_lag2')"), 3: "x = 'data/test.parquet'", 4: "y = 1",
        5: "def build_signal(view):\n    return view.select('ticker')", 6: "def build_signal(view):\n    return view.where('false').selectExpr('timestamp_agg', 'ticker', '1.0 signal')",
        7: "def build_signal(view):\n    return view.groupBy('ticker').agg({'timestamp_agg': 'max'}).selectExpr('`max(timestamp_agg)` timestamp_agg', 'ticker', '1.0 signal')",
        8: "def build_signal(view):\n    raise ValueError('boom')",
    }
    for n, text in texts.items():
        (tmp_path / f"code_{n:03d}.py").write_text(text)
    (tmp_path / "code_old.py").write_text("no number")
    (tmp_path / "notes.txt").write_text("not a snapshot")
    results, daily = snapshots.replay_folder(train, hidden, str(tmp_path))
    got = {r["check_num"]: r for r in results.collect()}
    assert {n: r["status"] for n, r in got.items()} == {
        1: "completed", 2: "completed", 3: "policy_violation", 4: "error", 5: "invalid_schema", 6: "invalid_signal", 7: "error", 8: "error",
    }
    assert got[8]["reason"] == "boom" and got[7]["reason"] == "a backtest needs two bars" and got[5]["reason"] == "missing columns: signal, timestamp_agg"
    view = features.view(train, hidden)
    for n, c in ((1, -F.col("residual_return_lag1")), (2, F.col("residual_return_lag2"))):
        signal = features.normalised(features.period(view.withColumn("signal", c).select("timestamp_agg", "ticker", "signal"), view))
        bars = backtest.backtest_bars(signal, hidden)
        assert abs(got[n]["hidden_oos_sharpe"] - backtest.daily_sharpe(backtest.daily_pnl(bars)).first()[0]) < 1e-9
        assert abs(got[n]["hidden_oos_max_drawdown"] - backtest.metrics(bars).first()["max_drawdown"]) < 1e-12
        assert abs(got[n]["mean_ic"] - stats.ic_summary(stats.ic_per_bar(stats.scored(signal, hidden))).first()["mean_ic"]) < 1e-12
        mine = {r["date"]: r["daily_ret"] for r in daily.where(F.col("check_num") == n).collect()}
        alone = {r["date"]: r["daily_ret"] for r in backtest.daily_pnl(bars).collect()}
        assert mine.keys() == alone.keys() and all(abs(mine[k] - alone[k]) < 1e-12 for k in mine)
    grouped = backtest.metrics(backtest.backtest_bars(features.normalised(view.where("is_prediction_period").withColumn("signal", -F.col("residual_return_lag1")).withColumn("check_num", F.lit(1)), by=("check_num",)), hidden, by=("check_num",)), by=("check_num",))
    assert grouped.first()["max_drawdown"] == got[1]["hidden_oos_max_drawdown"]


def test_nothing_to_replay(spark, panel, tmp_path):
    results, daily = snapshots.replay_folder(None, panel[1], str(tmp_path / "absent"))
    assert results.count() == 0 and daily.count() == 0
    assert [f.name for f in results.schema] == [x.split()[0] for x in snapshots.RESULT.split(", ")]


def test_columns_serve_as_candidates_and_share_one_panel_scan(panel):
    train, hidden = panel
    results, _ = snapshots.replay(train, hidden, {1: lambda v: F.col("residual_return_lag1"), 2: lambda v: v.select("timestamp_agg", "ticker", F.lit(1).alias("signal"))})
    assert [r["status"] for r in results.orderBy("check_num").collect()] == ["completed", "completed"]


def test_of_duplicate_keys_the_first_counts(panel):
    hidden = panel[1].withColumn("signal", F.col("close") % 7 - F.lit(3.0)).withColumn("seen", F.lit(1))
    twice = hidden.unionByName(hidden.where("ticker < 'C'").withColumn("signal", F.lit(9.0)).withColumn("seen", F.lit(2))).repartition(5)
    one = {r["timestamp_agg"]: r["equity_curve"] for r in backtest.backtest_bars(hidden).collect()}
    assert {r["timestamp_agg"]: r["equity_curve"] for r in backtest.backtest_bars(twice, order="seen").collect()} == pytest.approx(one)
    joined = backtest.backtest_bars(twice.select("timestamp_agg", "ticker", "signal", "seen"), hidden.drop("seen"), order="seen")
    assert {r["timestamp_agg"]: r["equity_curve"] for r in joined.collect()} == pytest.approx(one)
