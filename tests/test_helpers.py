"""Small helpers of results, manifests and replays."""

import os
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import portfolio, scoring
from tidepanel.plans import queries


def test_results_that_are_not_finite_fail():
    good = {"score": 0.5, "passed": True, "ic": 0.1}
    assert scoring.finite_or_fail(good, ["score", "ic"]) == good
    bad = scoring.finite_or_fail(good | {"ic": float("nan")}, ["score", "ic", "absent"])
    assert (bad["score"], bad["passed"], bad["not_finite"]) == (-1.0, False, ["ic", "absent"])


def test_table_text():
    assert scoring.table_text({"ic": 0.25, "bars": 3}) == "| metric | value |\n|---|---|\n| ic | 0.250000 |\n| bars | 3 |"


def test_code_paths():
    assert portfolio.code_path("/e", {"source_path": "a/b.py", "relative_path": "c"}) == Path("/e/a/b.py")
    assert portfolio.code_path("/e", {"code_path": "/x/y.py"}) == Path("/x/y.py")
    with pytest.raises(ValueError):
        portfolio.code_path("/e", {"code_path": ""})


def test_replay_records_failures(spark):
    def score(row):
        if row["model_name"] == "bad":
            raise RuntimeError("no data")
        return spark.createDataFrame([(date(2024, 1, 1), row["value"])], "date date, daily_ret double")

    manifest = [{"task_name": "t", "model_name": m, "repeat_idx": k, "value": float(k)} for k, m in enumerate(["a", "bad", "c", "d"])]
    streams, status = portfolio.replay(manifest, score, 3)
    assert [(r["model_name"], r["status"]) for r in status] == [("a", "completed"), ("bad", "failed"), ("c", "completed")] and status[1]["error"] == "no data"
    assert sorted((r["model_name"], r["repeat_idx"], r["daily_ret"]) for r in streams.collect()) == [("a", 0, 0.0), ("c", 2, 2.0)]
    assert streams.where(F.col("task_name") == "t").count() == 2
    assert portfolio.replay(manifest[1:2], score)[0] is None


def test_rows_of_both_periods_count_once_though_the_panel_does_not_repeat(spark, monkeypatch):
    rows = [(datetime(1999, 5, 1), "A", 1.0), (datetime(1999, 7, 1), "A", 2.0), (datetime(2000, 2, 1), "A", 3.0), (datetime(1999, 7, 1), "B", 4.0)]
    noise = F.udf(lambda: os.urandom(4).hex()).asNondeterministic()
    panel = spark.createDataFrame(rows, "timestamp_agg timestamp, ticker string, close double").withColumn("return", noise())
    monkeypatch.setattr(queries.A, "daily", lambda spark, sf_dir: panel)
    assert sorted(r["close"] for r in queries.QUERIES["task_full"](spark, "").collect()) == [1.0, 2.0, 3.0, 4.0]
