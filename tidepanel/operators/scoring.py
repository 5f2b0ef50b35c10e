"""Scoring rules as expressions over one-row metric frames, and small driver-side reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def steps(c: Column, *grades: tuple[float, float]) -> Column:
    """First grade whose bound the value reaches, 0 below all."""
    out = F
    for bound, grade in grades:
        out = out.when(c >= bound, grade)
    return out.otherwise(0.0)


def t_grade(c: Column) -> Column:
    return steps(c, (4, 1.0), (3, 0.8), (2, 0.6), (1, 0.2))


def sharpe_grade(c: Column) -> Column:
    return steps(c, (2, 1.0), (1.5, 0.8), (1, 0.4), (0.7, 0.2))


def autocorr_penalty(c: Column, dialect: str = "engine") -> Column:
    """0 from .50 to .999; below, linear up to .40 at .10; above, flat .40 or linear in the overshoot."""
    over = F.lit(0.4) if dialect == "engine" else F.least(F.lit(0.4), (c - 0.999) / 0.001 * 0.4)
    return F.when(c > 0.999, over).when(c >= 0.5, 0.0).when(c < 0.1, 0.4).otherwise((0.5 - c) / 0.4 * 0.4)


def combined(df: DataFrame, dialect: str = "engine") -> DataFrame:
    """Adds score and passed to rows with dk_tstat, sharpe, autocorrelation."""
    t, s, a = (F.col(c) for c in ("dk_tstat", "sharpe", "autocorrelation"))
    score = F.greatest(0.4 * t_grade(t) + 0.6 * sharpe_grade(s) - autocorr_penalty(a, dialect), F.lit(0.05))
    return df.withColumn("score", score).withColumn("passed", (t >= 1) & (s >= 0.7) & (F.col("score") >= 0.5))


def checker(df: DataFrame) -> DataFrame:
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    a = F.col("autocorrelation")
    ac = F.when(a.between(0.5, 0.95), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(a - 0.725) / 0.5))
    return df.withColumn("score", 0.45 * unit(F.col("dk_tstat") / 3) + 0.40 * unit(F.col("sharpe")) + 0.15 * ac)


def local(df: DataFrame, cheat: float = 0.9) -> DataFrame:
    ic = F.col("mean_ic")
    cheating = F.abs("return_correlation") > cheat
    return df.withColumn("score", F.when(cheating, -1.0).otherwise(F.least(F.greatest(100 * ic, F.lit(-1.0)), F.lit(1.5)))).withColumn("passed", ~cheating & (ic > 0.003))


def cheat_flag(df: DataFrame, limit: float = 0.9) -> DataFrame:
    return df.withColumn("cheating_detected", F.abs("return_correlation") > limit)


def implausible(df: DataFrame) -> DataFrame:
    """Flags of figures too good to be true; scoring does not use them."""
    return df.withColumns({"sharpe_flag": F.abs("sharpe") >= 7, "ic_flag": F.abs("mean_ic") >= 0.05, "positive_flag": F.col("ic_positive") >= 0.95})


def finite_or_fail(result: dict, names: list[str]) -> dict:
    """Score -1 and no pass where a figure is not finite."""
    bad = [n for n in names if not isinstance(result.get(n), (int, float)) or not math.isfinite(result[n])]
    return result | ({"score": -1.0, "passed": False, "not_finite": bad} if bad else {})


def decay_labels(df: DataFrame) -> DataFrame:
    c = F.abs("ic")
    return df.withColumn("label", F.when(c > 0.005, "Strong").when(c > 0.002, "Good").when(c > 0.001, "Moderate").when(c > 0.0003, "Weak").otherwise("Decayed"))


def gaps(df: DataFrame) -> DataFrame:
    """Relative gaps of in-sample and out-of-sample figures, in percent."""
    gap = lambda a, b: F.when(F.abs(a) > 1e-8, F.abs(F.col(a) - F.col(b)) / F.abs(a) * 100).otherwise(0.0)
    return df.withColumns({"ic_gap_pct": gap("is_ic", "oos_ic"), "sharpe_gap_pct": gap("is_sharpe", "oos_sharpe")})


def table_text(rows: dict) -> str:
    """Metrics as a two-column markdown table."""
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return "\n".join(["| metric | value |", "|---|---|", *(f"| {k} | {show(v)} |" for k, v in rows.items())])
