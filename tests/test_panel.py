"""Golden figures of the synthetic panel, gate controls, splits, and SQL parity of a few queries."""

import hashlib
import math
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import backtest, features, splits, stats
from tidepanel.plans import queries
from tidepanel.streaming.scores import bar_scores

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def golden(spark):
    rows = []
    for h in range(288):
        for i, name in enumerate(["BTC", "ETH", "SOL", "XRP", "ADA"]):
            a = (i - 2) + 0.3 * math.sin(h / 9) + 0.05 * (((h + i) % 3) - 1)
            r = 0.00035 * a + 0.001 * math.sin(0.37 * (h + 1) * (i + 2)) + 0.00033 * math.cos(h / 17) * math.cos(i + 1)
            rows.append((datetime(2024, 1, 1) + timedelta(hours=h), name, a, 100 + 0.05 * h + i + 0.1 * a, 1000.0 + 10 * i + h, r, r))
    df = spark.createDataFrame(rows, "timestamp_agg timestamp, ticker string, feature_alpha double, close double, volume double, residual_return double, `return` double")
    cut = datetime(2024, 1, 1) + timedelta(hours=168)
    return df.where(F.col("timestamp_agg") < cut).cache(), df.where(F.col("timestamp_agg") >= cut).cache()


def alpha(view):
    return view.withColumn("signal", F.col("feature_alpha"))


def test_golden_figures(golden):
    train, hidden = golden
    view = features.view(train, hidden)
    signal = features.normalised(features.period(alpha(view).select("timestamp_agg", "ticker", "signal"), view))
    rows = stats.scored(signal, hidden).cache()
    bars = backtest.backtest_bars(signal, hidden).cache()
    m = backtest.metrics(bars).first()
    ic = stats.ic_summary(stats.ic_per_bar(rows)).first()
    close = lambda a, b: abs(a - b) <= 1e-9 * max(1, abs(b))
    assert close(ic["mean_ic"], 0.00044438963281504814) and ic["n_timestamps"] == 119
    assert close(stats.dk_tstat(rows).first()[0], 26.756874592533975)
    assert close(stats.return_corr(rows).first()[0], 0.5647588835042668)
    assert close(m["total_return"], 0.13849436954271455) and close(m["max_drawdown"], -0.0006698497685418969) and close(m["turnover_ann"], 439.030772164859)
    assert close(backtest.daily_sharpe(backtest.daily_pnl(bars)).first()[0], 239.3054382835749)


def test_gate(golden):
    train, hidden = golden
    leak = lambda v: v.withColumn("signal", F.coalesce("residual_return", F.lit(0.0)))
    none = lambda v: v.withColumn("signal", F.lit(float("nan")))
    assert features.run_gate(alpha, train, hidden)["status"] == "passed"
    assert features.run_gate(leak, train, hidden)["reason"] == "current view changes the signal"
    assert features.run_gate(none, train, hidden)["reason"] == "insufficient rows"
    assert features.policy_violations("x = 'a/val.parquet?x'") and features.policy_violations("x = 'a/test.parquet'") and not features.policy_violations("x = 1")


def test_splits(spark):
    days = spark.range(2232).select((F.to_timestamp(F.lit("2020-01-01")) + F.make_dt_interval(F.col("id").cast("int"))).alias("timestamp_agg"))
    cut = datetime(2024, 1, 1)
    specs = splits.plan("t", days.where(F.col("timestamp_agg") < cut), days.where(F.col("timestamp_agg") >= cut), splits.SplitConfig())
    assert [s.name for s in specs] == ["rolling-001", "random-block-001", "stripe-month-mod2-h0", "rolling-002", "random-block-002", "stripe-month-mod2-h1"]
    for s in specs:
        train, test = splits.cut_split(days, s)
        assert train.join(test, "timestamp_agg").count() == 0
    with pytest.raises(ValueError):
        splits.SplitConfig(families=("other",))


@pytest.mark.parametrize("name", ["ic_per_bar", "backtest_hourly", "quantile_spread", "residualize", "split_validation", "portfolio_sharpe", "rsi", "ewm_mean", "ewm_std", "mad", "trailing_p99",
    "market_relative_vol", "corr_change", "rolling_rank_corr", "amihud", "flow_ratio", "walk_forward_ols", "walk_forward_ridge", "stream_bar_scores"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "orders", "part"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    a = queries.QUERIES[name](spark, SF).toPandas()
    b = con.execute(queries.SQL[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    order = [c for c in columns if a[c].dtype.kind != "f"] or columns
    a, b = (x[columns].sort_values(order).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in columns:
        if a[c].dtype.kind == "f":
            assert ((a[c] - b[c]).abs().fillna(0) < 1e-6).all() and (a[c].isna() == b[c].isna()).all(), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


def test_bundle_checksums(spark, tmp_path):
    for name, data in (("a.parquet", b"one"), ("b.parquet/part-0.parquet", b"two"), ("c.parquet/part-0.parquet", b"")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    want = sorted((str(p.relative_to(tmp_path)), p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.rglob("*") if p.is_file())
    assert sorted(map(tuple, queries.QUERIES["bundle_checksums"](spark, str(tmp_path)).collect())) == want


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_random_blocks():
    import random

    got = splits.random_blocks(datetime(2020, 1, 5), datetime(2026, 2, 10), random.Random(5))  # 74 months
    assert len(got) == 12 and all(a[1] < b[0] for a, b in zip(got, got[1:]))
    rng, first = random.Random(5), datetime(2020, 1, 1)
    offset = rng.choice([0, 1])
    starts = sorted(rng.sample(list(range(offset, 73, 2)), 12))
    assert [g[0] for g in got] == [splits.add_months(first, k) for k in starts]
    # 24 months: only the grid from the first month has twelve blocks
    assert [g[0] for g in splits.random_blocks(datetime(2020, 1, 1), datetime(2021, 12, 9), random.Random(1))] == [splits.add_months(first, k) for k in range(0, 24, 2)]
    assert splits.random_blocks(datetime(2020, 1, 1), datetime(2020, 1, 30), random.Random(1)) == ()


def test_optional_and_task_names(spark, tmp_path):
    from tidepanel.sources import panel

    assert panel.read_optional(spark, f"file://{tmp_path}/none", "a long").count() == 0
    spark.range(3).write.parquet(f"{tmp_path}/some")
    assert panel.read_optional(spark, f"file://{tmp_path}/some", "id long").count() == 3
    (tmp_path / "signal-b").mkdir()
    (tmp_path / "signal-a").mkdir()
    assert panel.tasks(spark, str(tmp_path), "all") == panel.tasks(spark, str(tmp_path)) and panel.tasks(spark, str(tmp_path), "y, x") == ["x", "y"]


def test_backtest_guards_and_row_index(spark):
    from tidepanel.functions.columns import with_row_index
    from tidepanel.operators import backtest

    at = [datetime(2024, 1, 1, k) for k in range(3)]
    rows = spark.createDataFrame([(t, n, 1.0, 0.01) for t in at for n in ("b", "a", None)], "timestamp_agg timestamp, ticker string, signal double, residual_return double")
    assert sorted((r["row"], r["ticker"] or "") for r in with_row_index(rows).collect()) == [(k, n) for k, n in enumerate(["", "", "", "a", "a", "a", "b", "b", "b"])]
    one = rows.where(F.col("timestamp_agg") == F.lit(at[0]))
    for bars in (backtest.backtest_bars(one), backtest.metrics(backtest.backtest_bars(rows.limit(0)))):
        with pytest.raises(Exception, match="two bars"):
            bars.collect()
    assert backtest.metrics(backtest.backtest_bars(rows)).first()["n_timestamps"] == 3


def test_constant_signal_falls_back_to_ic(spark):
    rows = spark.range(60).select((F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(hours=F.floor(F.col("id") / 3).cast("int"))).alias("timestamp_agg"), F.lit(1.0).alias("signal"), F.sin("id").alias("ret"), F.cos(F.col("id") * 7).alias("ret_next"))
    want = stats.ic_tstat(stats.ic_per_bar(rows)).first()[0]
    assert want and math.isclose(stats.dk_tstat(rows).first()[0], want, rel_tol=1e-9)
    assert stats.dk_tstat(rows, "evaluator").first()[0] == 0.0
    assert stats.dk_tstat(rows.limit(5)).first()[0] == 0.0


def test_scores_of_a_stream_equal_those_of_the_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=7 * k), f"s{k % 5}", float((k * 37) % 101) if k % 11 else None) for k in range(400)]
    for part in range(4):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], "timestamp_agg timestamp, ticker string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("timestamp_agg timestamp, ticker string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = bar_scores(source, "value").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append")
    sink.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    got = {(*r[:3], round(r[3], 9)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(*r[:3], round(r[3], 9)) for r in bar_scores(spark.read.parquet(str(tmp_path / "in")), "value").collect()}
    closed = {r for r in want if r[0] < start + timedelta(minutes=7 * 399) - timedelta(hours=4)}
    assert len(closed) > 100 and closed <= got <= want
