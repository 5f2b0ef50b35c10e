"""Least squares on any number of regressors, from moments that Spark sums and array functions solve.

A group's moments are one aggregate: rows, means and centred co-moments of the regressors and the target (stable, partial
sums are combined before the shuffle). Systems are solved by sweeping the co-moment matrix with array functions, so
neither rows nor matrices go through Python. Regressors that depend on earlier ones, or do not vary, get coefficient 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import TIME, is_finite

#: Share of a regressor's variation that earlier ones must leave unexplained.
TOLERANCE = 1e-9


def moments(df: DataFrame, y: str, xs: list[str], by: list[str]) -> DataFrame:
    """``by``, n, mean (regressors, then target) and co (their full co-moment matrix, row by row) over rows with all values finite."""
    names = [*xs, y]
    whole = reduce(lambda a, b: a & b, (is_finite(c) for c in names))
    rows = df.where(whole).select(*by, *(F.col(c).cast("double").alias(f"_v{k}") for k, c in enumerate(names)))
    pair = lambda a, b: F.covar_pop(f"_v{min(a, b)}", f"_v{max(a, b)}") * F.count(F.lit(1))
    k = range(len(names))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(f"_v{a}") for a in k)).alias("mean"), F.array(*(pair(a, b) for a in k for b in k)).alias("co"))


def solve(co: Column, k: int, ridge: float = 0.0, least: float = 1e-18) -> Column:
    """Coefficients of ``k`` regressors from the co-moments of regressors and target; ``ridge`` adds to the diagonal.

    One sweep a regressor. A pivot of at most ``least`` or ``TOLERANCE`` of its own variation drops the regressor.
    """
    w = k + 1
    diagonal = lambda p: F.get(co, p * (w + 1)) + ridge
    start = F.transform(co, lambda v, q: F.when((q % (w + 1) == 0) & (q < k * w), v + ridge).otherwise(v))

    def sweep(m: Column, p: Column) -> Column:
        pivot = F.get(m, p * (w + 1))
        kept = (pivot > least) & (pivot > TOLERANCE * diagonal(p))

        def cell(v: Column, q: Column) -> Column:
            row, column = F.floor(q / w).cast("int"), q % w
            swept = F.when(row == p, v / pivot).otherwise(v - F.get(m, row * w + p) * F.get(m, p * w + column) / pivot)
            return F.when(kept, swept).when(row == p, F.lit(0.0)).otherwise(v)

        return F.transform(m, cell)

    done = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), start, sweep)
    return F.filter(done, lambda v, q: (q % w == k) & (q < k * w))


def _fitted(found: DataFrame, k: int, ridge: float) -> DataFrame:
    """Adds beta and icept to rows of moments."""
    found = found.withColumn("beta", solve(F.col("co"), k, ridge))
    shift = F.aggregate(F.zip_with("beta", F.slice("mean", 1, k), lambda b, m: b * m), F.lit(0.0), lambda a, b: a + b)
    return found.withColumn("icept", F.get("mean", F.lit(k)) - shift)


def fit(df: DataFrame, y: str, xs: list[str], by: list[str], ridge: float = 0.0) -> DataFrame:
    """``by``, n, beta (array) and icept of the regression of ``y`` on ``xs`` and a constant within each group."""
    return _fitted(moments(df, y, xs, by), len(xs), ridge).select(*by, "n", "beta", "icept")


def _predicted(xs: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.get("beta", F.lit(k)) * F.col(x) for k, x in enumerate(xs)), F.col("icept"))


def residualize(df: DataFrame, y: str, xs: list[str], by: list[str] | None = None, name: str = "residual") -> DataFrame:
    """``df`` with the residual of each group's regression (default: of each bar); null where a value is missing."""
    by = by or [TIME]
    of = fit(df, y, xs, by).select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), "beta", "icept")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)))
    out = df.join(of, same, "left").withColumn(name, F.when(reduce(lambda a, b: a & b, (is_finite(x) for x in [*xs, y])), F.col(y) - _predicted(xs)))
    return out.select(*df.columns, name)


def walk_forward(df: DataFrame, y: str, xs: list[str], block: Column, ridge: float = 0.0, last: int | None = None, gap: int = 0, name: str = "predicted") -> DataFrame:
    """Prediction of ``y`` from ``xs`` by a regression over all rows of earlier blocks, or of the ``last`` of them.

    ``gap`` leaves out that many blocks before the predicted one (an embargo). Moments are summed per block; only block
    rows meet in the running window, where means are taken from the first block's, so that sums of squares stay small.
    Rows of blocks without earlier rows have null.
    """
    k = len(xs)
    d = df.withColumn("_block", block)
    per = moments(d, y, xs, ["_block"])
    blocks = d.select("_block").distinct().join(per, "_block", "left")
    every = Window.orderBy("_block")
    before = every.rowsBetween(Window.unboundedPreceding if last is None else -last - gap, -1 - gap)
    blocks = blocks.withColumn("_from", F.first("mean", ignorenulls=True).over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    off = lambda a: F.get("mean", F.lit(a)) - F.get("_from", F.lit(a))
    sums = [F.sum("n").over(before).alias("n"), *(F.sum(F.col("n") * off(a)).over(before).alias(f"_s{a}") for a in range(k + 1))]
    pairs = [(a, b) for a in range(k + 1) for b in range(a, k + 1)]
    sums += [F.sum(F.get("co", F.lit(a * (k + 1) + b)) + F.col("n") * off(a) * off(b)).over(before).alias(f"_q{a}_{b}") for a, b in pairs]
    run = blocks.select("_block", "_from", *sums)
    co = [F.col(f"_q{min(a, b)}_{max(a, b)}") - F.col(f"_s{a}") * F.col(f"_s{b}") / F.col("n") for a in range(k + 1) for b in range(k + 1)]
    run = run.where("n > 0").select("_block", F.array(*co).alias("co"), F.array(*(F.get("_from", F.lit(a)) + F.col(f"_s{a}") / F.col("n") for a in range(k + 1))).alias("mean"))
    of = _fitted(run, k, ridge).select("_block", "beta", "icept")
    return d.join(of, "_block", "left").withColumn(name, _predicted(xs)).select(*df.columns, name)
