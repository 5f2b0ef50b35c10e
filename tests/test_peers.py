"""Clusters, correlations in blocks and pair spreads against numpy and plain loops."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from tidepanel.operators import peers, scan
from tidepanel.plans import queries

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(2)
    base, rows = rng.normal(size=(3, 200)), []
    for k in range(12):
        for t in range(200):
            v = float(base[k % 3, t] + 0.3 * rng.normal()) * (1 + k % 3) + 100 * k
            rows.append((START + timedelta(hours=t), f"T{k:02d}", None if rng.random() < 0.1 else v))
    rows += [(START + timedelta(hours=t), "flat", 5.0) for t in range(200)] + [(START, "one", 1.0)]
    return rows, spark.createDataFrame(rows, "timestamp_agg timestamp, ticker string, x double")


@pytest.mark.parametrize("block,hours", [(256, 10_000), (3, 17)])
def test_correlations(panel, block, hours):
    rows, df = panel
    wide = pd.DataFrame(rows, columns=["t", "n", "x"]).pivot(index="t", columns="n", values="x").astype(float)
    got = {(r["ticker"], r["peer"]): (r["n"], r["corr"]) for r in peers.correlations(df, "x", block, hours * 3600).collect()}
    names = [c for c in wide.columns if c.startswith("T")]
    assert set(got) == {(a, b) for a in names for b in names if a != b}
    for (a, b), (n, corr) in got.items():
        both = wide[[a, b]].dropna()
        assert n == len(both) and abs(corr - both[a].corr(both[b])) < 1e-9
    near = {(r["ticker"], r["place"]): r["peer"] for r in peers.closest(peers.correlations(df, "x", block, hours * 3600), 2).collect()}
    assert len(near) == 24 and all(int(a[1:]) % 3 == int(b[1:]) % 3 for (a, _), b in near.items())


def test_pair_spread(panel):
    rows, df = panel
    pairs = peers.correlations(df, "x")
    near = {r["ticker"]: r["peer"] for r in peers.closest(pairs).collect()}
    at = {(t, n): x for t, n, x in rows}
    out = peers.pair_spread(df, pairs, "x").collect()
    assert len(out) == len(rows)
    for r in out:
        x, y = at[(r["timestamp_agg"], r["ticker"])], at.get((r["timestamp_agg"], near.get(r["ticker"])))
        assert r["peer"] == near.get(r["ticker"]) and r["pair_spread"] == (None if x is None or y is None else x - y)


def test_lloyd(spark):
    pts = [(f"P{k:02d}", float(10 * (k % 3) + 0.1 * k), float(k % 2)) for k in range(30)] + [("Z", None, 1.0)]
    df = spark.createDataFrame(pts, "ticker string, m double, s double")
    got = {r["ticker"]: r["cluster"] for r in peers.lloyd(df, ["m", "s"], 3).collect()}
    assert got.pop("Z") is None
    assert all(got[f"P{k:02d}"] == k % 3 for k in range(30))
    assert {r["cluster"] for r in peers.lloyd(df.where("false"), ["m", "s"], 3).collect()} == set()
    assert {r["cluster"] for r in peers.lloyd(df.where("ticker = 'P01'"), ["m", "s"], 2).collect()} == {0}


@pytest.mark.parametrize("block", [1024, 3])
def test_closest_peers_equal_those_of_all_pairs(spark, panel, block):
    rows, df = panel
    copies = spark.createDataFrame([(t, n, x) for t, _, x in rows if _ == "T04" for n in ("T04b", "T04a")] + [(START, None, 1.0)], df.schema)
    df = df.union(copies)
    want = {(r["ticker"], r["place"]): (r["peer"], r["n"], r["corr"]) for r in peers.closest(peers.correlations(df, "x"), 3).collect()}
    got = {(r["ticker"], r["place"]): (r["peer"], r["n"], r["corr"]) for r in peers.closest_peers(df, "x", 3, block).collect()}
    assert got.keys() == want.keys() and len(got) == 14 * 3
    for k, (peer, n, corr) in got.items():
        assert (peer, n) == want[k][:2] and abs(corr - want[k][2]) < 1e-9
    assert [got[("T04", k)][0] for k in (1, 2)] == ["T04a", "T04b"]  # equal series: by name
    assert peers.closest_peers(df.where("false"), "x").collect() == []


def test_closest_peers_over_many_bars_and_batches(spark):
    """More bars than a task's matrices hold at once, a ticker over several batches, all pairs left out that share too few bars."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=5_000)
    rows = [(START + timedelta(hours=t), n, float(base[t] * s + rng.normal())) for n, s in (("A", 1.0), ("B", 1.0), ("C", -1.0)) for t in range(5_000)] + [(START + timedelta(hours=t), "D", float(base[t])) for t in range(29)]
    df = spark.createDataFrame(rows, "timestamp_agg timestamp, ticker string, x double")
    wide = pd.DataFrame(rows, columns=["t", "n", "x"]).pivot(index="t", columns="n", values="x")
    got = {(r["ticker"], r["peer"]): (r["n"], r["corr"]) for r in peers.closest_peers(df, "x", 5).collect()}
    assert set(got) == {(a, b) for a in "ABC" for b in "ABC" if a != b}
    assert all(n == 5_000 and abs(corr - wide[a].corr(wide[b])) < 1e-12 for (a, b), (n, corr) in got.items())


def test_queries_of_peers_copy_no_rows(spark):
    near = queries.QUERIES["closest_peers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in near and near.count("Exchange hashpartitioning") == 1


def test_rows_of_pair_spread_stay_by_ticker(spark):
    spread = queries.QUERIES["pair_spread"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(timestamp_agg" not in spread and "hashpartitioning(_at" not in spread


def test_pair_spread_keeps_every_row(spark):
    rows = [(START, "A", 3.0), (START, "A", 4.0), (START, "B", 1.0), (START, None, 2.0), (START + timedelta(hours=1), "A", None), (START + timedelta(hours=1), "C", 9.0)]
    df = spark.createDataFrame(rows, "timestamp_agg timestamp, ticker string, x double")
    pairs = spark.createDataFrame([("A", "B", 30, 0.5), ("B", "C", 30, 0.1), ("C", "Z", 30, 0.9)], "ticker string, peer string, n long, corr double")
    got = sorted(((r["ticker"], r["x"], r["peer"], r["pair_spread"]) for r in peers.pair_spread(df, pairs, "x").collect()), key=str)
    assert got == sorted([("A", 3.0, "B", 2.0), ("A", 4.0, "B", 3.0), ("A", None, "B", None), ("B", 1.0, "C", None), ("C", 9.0, "Z", None), (None, 2.0, None, None)], key=str)
