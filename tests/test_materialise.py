"""Split tasks written by one job each: rows, ranges, metadata, manifests, instructions."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import splits, transforms
from tidepanel.sources import panel

START = datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def task(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("tasks") / "signal-test"
    rows = [(START + timedelta(days=d), n, float(d)) for d in range(0, 1800, 3) for n in ("A", "B")]
    df = spark.createDataFrame(rows, "timestamp_agg timestamp, ticker string, close double")
    cut = datetime(2023, 7, 1)
    for name, part in ((panel.TRAIN, df.where(F.col("timestamp_agg") < cut)), (panel.TEST, df.where(F.col("timestamp_agg") >= cut).withColumn("extra", F.lit(1)))):
        (home / name).parent.mkdir(parents=True, exist_ok=True)
        part.write.parquet(str(home / name))
    (home / "instruction.md").write_text("Do it.\n")
    (home / "tests/check.py").write_text("x = 1\n")
    (home / "__pycache__").mkdir()
    (home / "__pycache__/x.pyc").write_text("no")
    return str(home)


KEYS = {"split", "stripe_unit", "stripe_modulus", "stripe_holdout", "stripe_basis", "train_start", "train_end", "val_start", "val_end", "train_rows", "val_rows"}


def test_validation_tasks(spark, task, tmp_path):
    config = splits.ValidationConfig("is-month-stripe", "month", 3, 1)
    out = splits.materialise_validation(spark, [task], str(tmp_path / "v"), config, str(tmp_path / "m.json"), str(tmp_path / "m.parquet"))
    home = tmp_path / "v/signal-test"
    assert json.loads((home / "split_metadata.json").read_text()) == out[0] and json.loads((tmp_path / "m.json").read_text()) == out
    made = out[0]["validation"]
    assert set(made) == KEYS and (out[0]["task_name"], out[0]["split_family"]) == ("signal-test", "base")
    train, test, _ = panel.read_task(spark, task)
    left, value, same = (spark.read.parquet(str(home / p)) for p in (panel.TRAIN, panel.VAL, panel.TEST))
    assert left.count() == made["train_rows"] and value.count() == made["val_rows"] and made["train_rows"] + made["val_rows"] == train.count()
    assert same.exceptAll(test).count() == 0 and same.count() == test.count()
    both = left.unionByName(value)
    assert both.drop("extra").exceptAll(train).count() == 0
    low, high = value.agg(F.min("timestamp_agg"), F.max("timestamp_agg")).first()
    assert (made["val_start"], made["val_end"]) == (low.isoformat(), high.isoformat())
    months = sorted({(r[0].year, r[0].month) for r in train.select("timestamp_agg").collect()})
    held = {(r[0].year, r[0].month) for r in value.select("timestamp_agg").collect()}
    assert held == {m for k, m in enumerate(months) if k % 3 == 1}
    report = splits.validation_report(train, config).first().asDict()
    assert panel.plain(report) == made
    assert (home / "instruction.md").read_text().count(splits.MARKER) == 1 and not splits.add_instruction(spark, str(home))
    assert (home / "tests/check.py").exists() and not (home / "__pycache__").exists()
    flat = spark.read.parquet(str(tmp_path / "m.parquet")).first()
    assert json.loads(flat["validation"]) == made
    assert splits.materialise_validation(spark, [task], str(tmp_path / "w"), splits.ValidationConfig(), None, str(tmp_path / "none.parquet")) == []
    assert spark.read.parquet(str(tmp_path / "none.parquet")).columns == list(splits.NO_SPLITS)


def test_split_tasks(spark, task, tmp_path):
    config = splits.SplitConfig(("rolling", "stripe"), 2, 0, 24, ("month",))
    out = splits.materialise(spark, task, str(tmp_path / "s"), config, splits.ValidationConfig("is-month-stripe"), str(tmp_path / "m.json"), str(tmp_path / "m.parquet"))
    train, test, _ = panel.read_task(spark, task)
    full = panel.full_frame(train, test).cache()
    specs = splits.plan("signal-test", train, test, config)
    assert [r["name"] for r in out] == [s.name for s in specs] == ["rolling-001", "stripe-month-mod2-h0"]
    for row, spec in zip(out, specs, strict=True):
        home = tmp_path / f"s/signal-test--{spec.name}"
        left, right = splits.cut_split(full, spec)
        parts = {p: spark.read.parquet(str(home / p)) for p in (panel.TRAIN, panel.TEST, panel.VAL)}
        assert parts[panel.TEST].exceptAll(right).count() == 0 and row["test_rows"] == right.count() == parts[panel.TEST].count()
        assert parts[panel.TRAIN].unionByName(parts[panel.VAL]).exceptAll(left).count() == 0
        assert row["train_rows"] + row["val_rows"] == left.count() and row["details_validation"]["val_rows"] == row["val_rows"]
        assert json.loads((home / "split_metadata.json").read_text()) == row
    assert spark.read.parquet(str(tmp_path / "m.parquet")).count() == 2


def test_a_missing_side_is_an_error(spark, task, tmp_path):
    held = splits.ValidationConfig("is-month-stripe", "month", 500, 499)
    with pytest.raises(ValueError, match="no rows for val"):
        splits.materialise_validation(spark, [task], str(tmp_path / "v"), held)
    with pytest.raises(FileNotFoundError):
        panel.read_task(spark, str(tmp_path))


def test_configurations_from_text(spark, task, tmp_path):
    made = splits.config_of("volume-variety", " rolling, stripe", "0", "3", "day,", "-5")
    assert made == splits.SplitConfig(("rolling", "stripe"), 1, 3, 0, ("day",), "volume-variety")
    assert splits.config_of() == splits.SplitConfig(count=1, preset="none")
    assert splits.materialise(spark, task, str(tmp_path / "none"), splits.config_of()) == []
    for bad in ({"preset": "other"}, {"families": "monthly"}, {"stripe_units": "year"}):
        with pytest.raises(ValueError):
            splits.config_of(**bad)


def test_wide_takes_the_first_of_equal_keys(spark):
    rows = [(START, "B", 1.0, 2), (START, "B", 9.0, 1), (START, "A", 3.0, 1), (START + timedelta(days=1), "A", None, 1)]
    df = spark.createDataFrame(rows, "timestamp_agg timestamp, ticker string, x double, k int")
    out = transforms.wide(df, "x", order="k")
    assert out.columns == ["timestamp_agg", "A", "B"] and sorted((r["A"], r["B"]) for r in out.where("A is not null").collect()) == [(3.0, 9.0)]
    assert out.count() == 2 and transforms.wide(df.where("false"), "x").columns == ["timestamp_agg"]
    with pytest.raises(ValueError):
        transforms.wide(df, "x", most=1)


def test_profiles_of_any_store(spark, tmp_path):
    (tmp_path / "p.toml").write_text("[split]\ncount = 3\n")
    assert panel.load_profile(spark, str(tmp_path / "p.toml")) == {"split": {"count": 3}}
