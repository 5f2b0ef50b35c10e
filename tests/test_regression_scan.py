"""Regressions on several columns against numpy, recursions along tickers against pandas and plain loops."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions.columns import own
from tidepanel.operators import regression, scan, transforms
from tidepanel.plans import queries

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    out = []
    for t in range(30):
        for i in range(25):
            x = rng.normal(size=5) * [1, 10, 0.01, 100, 1] + [0, 5, 0, 1e4, 1]
            y = float(x @ [0.5, -0.1, 3, 0.001, 0] + 2 + rng.normal() * 0.1)
            out.append((START + timedelta(hours=t), f"T{i}", *map(float, x), y))
    out[3] = (*out[3][:2], None, *out[3][3:])
    out[40] = (*out[40][:7], float("nan"))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "timestamp_agg timestamp, ticker string, a double, b double, c double, d double, e double, y double")


def solved(x, y):
    return np.linalg.lstsq(np.c_[np.ones(len(x)), x], y, rcond=None)[0]


@pytest.mark.parametrize("xs", [["a"], ["a", "b"], ["a", "b", "c", "d", "e"]])
def test_residuals_of_each_bar(frame, rows, xs):
    got = {(r["timestamp_agg"], r["ticker"]): r["residual"] for r in regression.residualize(frame, "y", xs).collect()}
    table = pd.DataFrame(rows, columns=["t", "n", "a", "b", "c", "d", "e", "y"])
    assert len(got) == len(rows)
    for t, bar in table.groupby("t"):
        whole = bar.dropna(subset=[*xs, "y"])
        beta = solved(whole[xs].to_numpy(), whole["y"].to_numpy())
        want = dict(zip(whole["n"], whole["y"] - np.c_[np.ones(len(whole)), whole[xs]] @ beta, strict=True))
        for n in bar["n"]:
            value = got[(t.to_pydatetime(), n)]
            assert (value is None) == (n not in want) and (value is None or abs(value - want[n]) < 1e-8)


def test_dependent_and_constant_columns_are_dropped(spark):
    data = [(START, f"T{i}", float(i), 2.0 * i + 1, 7.0, 3.0 * i - 1) for i in range(9)]
    df = spark.createDataFrame(data, "timestamp_agg timestamp, ticker string, a double, b double, c double, y double")
    r = regression.fit(df, "y", ["a", "b", "c"], ["timestamp_agg"]).first()
    assert np.allclose(r["beta"], [3, 0, 0]) and abs(r["icept"] + 1) < 1e-9
    one = regression.fit(df.where("ticker = 'T3'"), "y", ["a", "b"], ["timestamp_agg"]).first()
    assert one["beta"] == [0.0, 0.0] and one["icept"] == 8.0


@pytest.mark.parametrize("ridge,last,gap", [(0.0, None, 0), (5.0, None, 0), (0.0, 3, 0), (2.0, 2, 1)])
def test_walk_forward(frame, rows, ridge, last, gap):
    xs = ["a", "b", "d"]
    block = F.floor((F.unix_timestamp("timestamp_agg") - int(START.timestamp())) / (5 * 3600)).cast("int")
    got = {(r["timestamp_agg"], r["ticker"]): r["predicted"] for r in regression.walk_forward(frame, "y", xs, block, ridge, last, gap).collect()}
    table = pd.DataFrame(rows, columns=["t", "n", "a", "b", "c", "d", "e", "y"])
    table["k"] = [int((t - pd.Timestamp(START)) / pd.Timedelta(hours=5)) for t in table["t"]]
    for k, part in table.groupby("k"):
        upto = k - 1 - gap
        past = table[(table["k"] <= upto) & (table["k"] > (-1 if last is None else upto - last))].dropna(subset=[*xs, "y"])
        for r in part.itertuples():
            value = got[(r.t.to_pydatetime(), r.n)]
            if past.empty or pd.isna(r.a):
                assert value is None
                continue
            x, y = past[xs].to_numpy(), past["y"].to_numpy()
            beta = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + ridge * np.eye(3), (x - x.mean(0)).T @ (y - y.mean()))
            assert abs(value - (y.mean() + (np.array([r.a, r.b, r.d]) - x.mean(0)) @ beta)) < 1e-7


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    out = []
    for name, n, level in (("A", 6_000, 1e3), ("B", 10, 0.0), (None, 50, 1.0)):
        for t in range(n):
            v = None if rng.random() < 0.1 else float(level + rng.normal())
            out.append((START + timedelta(hours=int(t * 2 + rng.integers(0, 2))), name, v))
    return out, spark.createDataFrame(out, "timestamp_agg timestamp, ticker string, x double").repartition(7)


@pytest.mark.parametrize("alpha", [0.02, 0.3, 0.9])
def test_ewm_is_exact_over_many_slices(series, alpha):
    rows, df = series
    out = scan.ewm(df, "x", alpha, seconds=5 * scan.DAY)
    got = pd.DataFrame([r.asDict() for r in out.collect()]).sort_values("timestamp_agg")
    assert len(got) == len(rows)
    for name in ("A", "B", None):
        mine = got[got["ticker"].isna() if name is None else got["ticker"] == name]
        # pandas' own deviation subtracts running squares, so it is taken about the level
        want = pd.Series(mine["x"].to_numpy()).ewm(alpha=alpha, ignore_na=False)
        mean, std = mine["ewm_mean"].to_numpy(dtype=float), mine["ewm_std"].to_numpy(dtype=float)
        np.testing.assert_allclose(mean, want.mean().to_numpy(), rtol=1e-12, atol=1e-12)
        np.testing.assert_allclose(std[2:], want.std().to_numpy()[2:], rtol=1e-7, atol=1e-7)


def test_one_ticker_is_spread_over_tasks(series):
    _, df = series
    d = scan.decayed_sums(df.where("ticker = 'A'"), {"s": F.col("x")}, {"s": 0.9}, scan.slice_of(5 * scan.DAY))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ticker" in plan and "_slice" in plan
    assert df.where("ticker = 'A'").select(scan.slice_of(5 * scan.DAY).alias("k")).distinct().count() > 90


@pytest.mark.parametrize("back,size", [(19, 19), (19, 50), (40, 5_000)])
def test_windows_over_slices_equal_those_over_tickers(series, back, size):
    _, df = series
    f = lambda x: x.withColumn("z", transforms.ts_zscore("x", 20)).withColumn("m", F.lag("x", 3).over(own()))
    got = scan.over_slices(df, f, back, size, 5 * scan.DAY)
    want = f(df)
    assert got.columns == want.columns and got.schema[1].dataType == df.schema[1].dataType
    key = lambda r: (str(r["ticker"]), r["timestamp_agg"])
    a, b = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert [key(r) for r in a] == [key(r) for r in b] and [r["m"] for r in a] == [r["m"] for r in b]
    assert all((x["z"] is None) == (y["z"] is None) and (x["z"] is None or abs(x["z"] - y["z"]) < 1e-9) for x, y in zip(a, b, strict=True))
    places = scan.with_place(df.where("ticker = 'A'"), 5 * scan.DAY).orderBy("timestamp_agg").collect()
    assert [r["place"] for r in places] == list(range(6_000))
    with pytest.raises(ValueError):
        scan.over_slices(df, f, 5, 4)


def test_wilder_against_a_loop(series):
    rows, df = series
    got = {(r["ticker"], r["timestamp_agg"]): r["w"] for r in scan.wilder(df, {"w": F.col("x")}, 14, seconds=3 * scan.DAY).collect()}
    for name in ("A", "B", None):
        s = None
        for t, _, v in sorted((r for r in rows if r[1] == name), key=lambda r: r[0]):
            if v is None:
                assert got[(name, t)] is None
                continue
            s = v if s is None else s + (v - s) / 14
            assert abs(got[(name, t)] - s) <= 1e-12 * max(1, abs(s))


def test_adx_and_hysteresis_against_loops(spark):
    rng = np.random.default_rng(5)
    close = 100 + np.cumsum(rng.normal(size=400))
    data = [(START + timedelta(hours=t), "A", float(c + abs(rng.normal())), float(c - abs(rng.normal())), float(c)) for t, c in enumerate(close)]
    df = spark.createDataFrame(data, "timestamp_agg timestamp, ticker string, high double, low double, close double")
    got = sorted(scan.hysteresis(scan.adx(df, "high", "low", "close", 14, 5 * scan.DAY), "adx", 25.0, 15.0).collect(), key=lambda r: r["timestamp_agg"])
    smooth, adx, state = None, None, 0
    for k, r in enumerate(got):
        if k:
            (_, _, h0, l0, c0), (_, _, h, l, _) = data[k - 1], data[k]
            up, down = h - h0, l0 - l
            now = np.array([up if up > down and up > 0 else 0, down if down > up and down > 0 else 0, max(h - l, abs(h - c0), abs(l - c0))])
            smooth = now if smooth is None else smooth + (now - smooth) / 14
            p, m = 100 * smooth[:2] / smooth[2]
            dx = 100 * abs(p - m) / (p + m) if p + m else 0.0
            adx = dx if adx is None else adx + (dx - adx) / 14
            state = 1 if adx >= 25 else 0 if adx <= 15 else state
            assert np.allclose([r["plus_di"], r["minus_di"], r["adx"]], [p, m, adx], atol=1e-9)
        else:
            assert r["adx"] is None
        assert r["regime"] == state
    with pytest.raises(ValueError):
        scan.hysteresis(df, "close", 1.0, 1.0)
    with pytest.raises(ValueError):
        scan.decayed_sums(df, {"s": F.col("close")}, {"s": 1.0}, scan.slice_of(60))


@pytest.mark.parametrize("n", [2, 14])
def test_smoothing_along_tickers_against_a_loop(spark, n):
    """Several runs (n = 2: 664 rows each), gaps, a ticker that starts with missing values and one without a name."""
    rng = np.random.default_rng(8)
    rows = [(START + timedelta(hours=t), name, None if t < 5 or rng.random() < 0.1 else float(rng.normal())) for name in ("A", "B", None) for t in range(2_500 if name == "A" else 40)]
    df = spark.createDataFrame(rows, "timestamp_agg timestamp, ticker string, x double")
    got = {(r["ticker"], r["timestamp_agg"]): r["w"] for r in scan.smoothed(df, {"w": F.col("x")}, n).collect()}
    assert len(got) == len(rows)
    for name in ("A", "B", None):
        s = None
        for t, _, v in sorted((r for r in rows if r[1] == name), key=lambda r: r[0]):
            if v is None:
                assert got[(name, t)] is None
                continue
            s = v if s is None else s + (v - s) / n
            assert abs(got[(name, t)] - s) <= 1e-12 * max(1, abs(s))
    with pytest.raises(ValueError):
        scan.smoothed(df, {"w": F.col("x")}, 1)


def test_adx_along_tickers_equals_adx_over_slices_on_one_shuffle(spark):
    rng = np.random.default_rng(9)
    rows = [(START + timedelta(hours=t), k, *map(float, (c + abs(rng.normal()), c - abs(rng.normal()), c))) for k in "AB" for t, c in enumerate(100 + np.cumsum(rng.normal(size=90)))]
    df = spark.createDataFrame(rows, "timestamp_agg timestamp, ticker string, high double, low double, close double")
    one, many = ({(r["ticker"], r["timestamp_agg"]): (r["plus_di"], r["minus_di"], r["adx"]) for r in scan.adx(df, "high", "low", "close", 14, x).collect()} for x in (None, 2 * scan.DAY))
    assert one.keys() == many.keys() and len(one) == 180
    for k, x in one.items():
        assert [v is None for v in x] == [v is None for v in many[k]] and np.allclose([v or 0 for v in x], [v or 0 for v in many[k]], atol=1e-9)
    query = queries.QUERIES["adx_regime"](spark, "/root/testdata/sf0.001")
    assert query._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
