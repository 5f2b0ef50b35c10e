"""Feature views: safe lags, masked labels, periods, and the views and deltas of the causality gate."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS, NAME, TIME, any_of, is_finite, lcg_noise, own, with_row_index, zscore

LAGS = (1, 2, 3, 6, 12, 24)
FLAG = "is_prediction_period"
Signal = Callable[[DataFrame], DataFrame]


def return_columns(df: DataFrame, target: str = "residual_return") -> list[str]:
    return [c for c in dict.fromkeys([target, "residual_return", "return"]) if c in df.columns]


def with_lags(df: DataFrame, columns: list[str], lags: tuple[int, ...] = LAGS) -> DataFrame:
    """<column>_lag<k>: the value k rows earlier of the same ticker."""
    return df.select("*", *(F.lag(c, k).over(own()).alias(f"{c}_lag{k}") for c in columns for k in lags))


def with_leads(df: DataFrame, column: str, horizons: tuple[int, ...]) -> DataFrame:
    return df.select("*", *(F.lead(column, h).over(own()).alias(f"{column}_lead{h}") for h in horizons))


def mask(df: DataFrame, columns: list[str], mode: str = "null") -> DataFrame:
    """Returns of prediction rows: null, the first lag, or untouched."""
    if mode in ("raw", "none"):
        return df
    other = {c: F.col(f"{c}_lag1") if mode == "lagged" else F.lit(None).cast("double") for c in columns}
    return df.withColumns({c: F.when(F.col(FLAG), v).otherwise(F.col(c)) for c, v in other.items()})


def view(train: DataFrame | None, hidden: DataFrame, mode: str = "null") -> DataFrame:
    """Train and hidden rows with their flag, lags computed before returns are masked."""
    rows = hidden.withColumn(FLAG, F.lit(True))
    if train is not None:
        rows = train.withColumn(FLAG, F.lit(False)).unionByName(rows, allowMissingColumns=True)
    columns = return_columns(rows)
    return mask(with_lags(rows, columns), columns, mode)


def period(signal: DataFrame, features: DataFrame, prediction: bool = True, dialect: str = "engine") -> DataFrame:
    """Signal rows of one period; the evaluator dialect does not make keys unique first."""
    keys = features.where(F.col(FLAG) == prediction).select(*KEYS)
    if dialect == "engine":
        return signal.select(*KEYS, "signal").join(keys.distinct(), KEYS)
    return signal.join(keys, KEYS)


def normalised(signal: DataFrame, dialect: str = "engine", by: tuple[str, ...] = ()) -> DataFrame:
    return signal.withColumn("signal", zscore("signal", dialect, by))


def gate_bars(hidden: DataFrame, days: int = 1) -> list:
    """Bars at which the gate looks: the second one, and for more days the middle and the last but one."""
    bars = hidden.select(TIME).distinct()
    n = bars.count()
    picks = [min(1, n - 1)] if days <= 1 else sorted({min(1, n - 1), n // 2, max(0, n - 2)})[:days]
    place = F.row_number().over(Window.orderBy(TIME)) - 1
    rows = bars.withColumn("i", place).where(F.col("i").isin(picks)).orderBy("i").collect()
    return [r[TIME] for r in rows]


def sentinels(hidden: DataFrame, at) -> list:
    """First and last bar after ``at``."""
    low, high = hidden.where(F.col(TIME) > F.lit(at)).agg(F.min(TIME), F.max(TIME)).first()
    return sorted({x for x in (low, high) if x is not None})


def gate_view(train: DataFrame | None, hidden: DataFrame, at, *, current_noise: bool = False, future: list | None = None) -> DataFrame:
    """What a candidate may see at bar ``at``.

    Hidden rows up to ``at`` (and the given future bars) with lags; returns at ``at`` are null, or noise;
    returns of the future bars are noise. A candidate that does not look ahead scores ``at`` alike.
    """
    rows = hidden.where((F.col(TIME) <= F.lit(at)) | any_of(TIME, future or [])).withColumn(FLAG, F.col(TIME) == F.lit(at))
    if train is not None:
        rows = train.withColumn(FLAG, F.lit(False)).unionByName(rows, allowMissingColumns=True)
    columns = return_columns(rows)
    place = next(c for c in ("row", "_row", "__row") if c not in rows.columns)
    rows = with_row_index(with_lags(rows, columns), place)
    noise = lcg_noise(place)

    def changed(c: str) -> Column:
        now = noise if current_noise else F.lit(None).cast("double")
        return F.when(F.col(TIME) == F.lit(at), now).when(F.col(TIME) > F.lit(at), noise).otherwise(F.col(c))

    return rows.withColumns({c: changed(c) for c in columns}).drop(place)


def delta(left: DataFrame, right: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """One row: shared keys, largest difference, differing and missing rows of two signals."""
    a, b = left.select(*KEYS, F.col("signal").alias("l")), right.select(*KEYS, F.col("signal").alias("r"))
    d = F.abs(F.col("l") - F.col("r"))
    both = a.join(b, KEYS, "full_outer")
    there = F.col("l").isNotNull() & F.col("r").isNotNull()
    n = F.greatest(F.count("l"), F.count("r"))
    return both.agg(
        F.sum(there.cast("long")).alias("shared"), F.coalesce(F.max(d), F.lit(0.0)).alias("max_delta"),
        F.coalesce(F.sum((d > tolerance).cast("long")), F.lit(0)).alias("changed"), (n - F.sum(there.cast("long"))).alias("missing"),
    )


def run_gate(signal: Signal, train: DataFrame | None, hidden: DataFrame, days: int = 1, min_coverage: float = 0.01, tolerance: float = 1e-8) -> dict:
    """Runs a candidate on three views per gate bar; passes if labels at the bar and all that follows leave it unmoved."""

    def at_bar(frame: DataFrame) -> DataFrame:
        return normalised(signal(frame).where(F.col(FLAG)).select(*KEYS, "signal").where(is_finite("signal")))

    bars = []
    for at in gate_bars(hidden, days):
        expected = hidden.where(F.col(TIME) == F.lit(at)).select(*KEYS).distinct().count()
        base = at_bar(gate_view(train, hidden, at)).persist()
        found = base.count()
        result = {"bar": at, "expected": expected, "rows": found, "status": "passed", "reason": ""}
        if found < max(1, int(expected * min_coverage)):
            result |= {"status": "failed", "reason": "insufficient rows"}
        else:
            for kind, frame in (("current", gate_view(train, hidden, at, current_noise=True)), ("future", gate_view(train, hidden, at, future=sentinels(hidden, at)))):
                try:
                    d = delta(base, at_bar(frame), tolerance).first().asDict()
                except Exception as e:  # a candidate's own error is a verdict, not ours
                    d = {"error": str(e)[:500]}
                result[kind] = d
                if result["status"] == "passed" and ("error" in d or d["missing"] or d["max_delta"] > tolerance):
                    result |= {"status": "failed", "reason": f"{kind} view changes the signal"}
        base.unpersist()
        bars.append(result)
    failed = [b for b in bars if b["status"] != "passed"]
    return {"status": "failed" if failed else "passed", "reason": failed[0]["reason"] if failed else "", "bars": bars}


#: What a candidate's text must not hold inside a string.
POLICY = (r"""['"][^'"]*/tests/[^'"]*['"]""", r"""['"][^'"]*test\.parquet[^'"]*['"]""", r"""['"][^'"]*val\.parquet[^'"]*['"]""")


def policy_violations(text: str) -> list[str]:
    return [p for p in POLICY if re.search(p, text)]


def policy_scan(codes: DataFrame, column: str = "code") -> DataFrame:
    """``codes`` with the number of patterns that each text breaks."""
    hits = sum((F.col(column).rlike(p).cast("int") for p in POLICY[1:]), F.col(column).rlike(POLICY[0]).cast("int"))
    return codes.withColumn("violations", hits)
