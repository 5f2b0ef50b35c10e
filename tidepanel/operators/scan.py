"""Exact recursions along tickers (exponential weights, Wilder smoothing) as a scan on two levels.

A ticker is cut into time slices, and those into runs of at most ``most_rows`` rows. Every run sums its own rows with
weights that decay by the row; only one row a run, its carry, goes along the ticker; then the runs are finished with
the carry that reaches them. So a ticker of any length is spread over as many tasks as it has slices.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import NAME, TIME, is_finite, safe_div

DAY = 86_400


def slice_of(seconds: int) -> Column:
    """Number of the time slice of that length."""
    return F.floor(F.unix_timestamp(TIME) / seconds).cast("long")


def most_rows(keep: float) -> int:
    """Rows of a run: so few that the inverse weights stay far from overflow."""
    return max(1, min(4096, int(200 / -math.log10(keep))))


def reach(keep: float) -> int:
    """Rows after which what is carried is below 1e-20 of its weight."""
    return math.ceil(-20 / math.log10(keep))


def with_place(df: DataFrame, seconds: int = 30 * DAY, name: str = "place") -> DataFrame:
    """``name``: number of the row within its ticker, from 0, counted slice by slice; only slices' counts go along a ticker."""
    d = df.withColumn("_slice", slice_of(seconds))
    d = d.withColumn("_row", F.row_number().over(Window.partitionBy(NAME, "_slice").orderBy(TIME)) - 1)
    before = F.sum("_n").over(Window.partitionBy(NAME).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    counts = d.groupBy(NAME, "_slice").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    counts = counts.select(F.col(NAME).alias("_name"), F.col("_slice").alias("_slice2"), "_before")
    same = F.col(NAME).eqNullSafe(F.col("_name")) & F.col("_slice").eqNullSafe(F.col("_slice2"))
    return d.join(counts, same, "left").select(*df.columns, (F.col("_row") + F.col("_before")).alias(name))


def over_slices(df: DataFrame, apply: Callable[[DataFrame], DataFrame], back: int, size: int = 1 << 16, seconds: int = 30 * DAY) -> DataFrame:
    """``apply`` on runs of ``size`` rows of a ticker, each with the ``back`` rows before it, so that long tickers are many tasks.

    For transforms of a ticker's own last rows (windows of ``own``): ``back`` is how many rows they look back, all in all.
    They see a run in place of the ticker and must keep the frame's rows and columns; cross-sections of a bar do not belong
    here, as rows that only serve as history stand in two runs. A run's size must not lie below ``back``.
    """
    if not 0 <= back <= size:
        raise ValueError("the rows looked back on must fit into one run")
    d = with_place(df, seconds, "_place")
    run, late = F.floor(F.col("_place") / size), F.col("_place") % size >= size - back
    own, next_ = F.struct(run.alias("run"), F.lit(False).alias("past")), F.struct((run + 1).alias("run"), F.lit(True).alias("past"))
    d = d.withColumn("_run", F.explode(F.array_compact(F.array(own, F.when(late, next_))))).withColumn("_own", F.col(NAME))
    out = apply(d.withColumn(NAME, F.struct(F.col("_own"), F.col("_run.run").alias("run"))))
    return out.where(~F.col("_run.past")).withColumn(NAME, F.col("_own")).drop("_own", "_run", "_place")


def decayed_sums(df: DataFrame, terms: dict[str, Column], keep: dict[str, float], slices: Column) -> DataFrame:
    """``df`` with s[t] = keep * s[t-1] + term[t] along each ticker in time order, for every named term (null terms add nothing).

    Each ``keep`` lies between 0 and 1. Equal times of a ticker follow one another in an undefined order.
    """
    if not terms or any(not 0 < keep[c] < 1 for c in terms):
        raise ValueError("a recursion needs terms that keep a share between 0 and 1")
    size = min(most_rows(keep[c]) for c in terms)
    d = df.withColumn("_slice", slices)
    d = d.withColumn("_row", F.row_number().over(Window.partitionBy(NAME, "_slice").orderBy(TIME)) - 1)
    d = d.withColumn("_run", F.floor(F.col("_row") / size)).withColumn("_at", F.col("_row") % size + 1)
    upto = Window.partitionBy(NAME, "_slice", "_run").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    weight = {c: F.pow(F.lit(keep[c]), F.col("_at")) for c in terms}
    d = d.withColumns({f"_s_{c}": F.coalesce(F.sum(t.cast("double") / weight[c]).over(upto), F.lit(0.0)) * weight[c] for c, t in terms.items()})

    runs = d.groupBy(NAME, "_slice", "_run").agg(F.count(F.lit(1)).alias("_n"), *(F.max_by(f"_s_{c}", "_at").alias(f"_c_{c}") for c in terms))
    along = Window.partitionBy(NAME).orderBy("_slice", "_run")
    runs = runs.withColumn("_end", F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy(NAME).orderBy("_end").rangeBetween(-max(reach(keep[c]) for c in terms) - size, -1)
    runs = runs.withColumn("_past", F.collect_list(F.struct("_end", *(f"_c_{c}" for c in terms))).over(back))
    start = F.col("_end") - F.col("_n")

    def carry(c: str) -> Column:
        return F.aggregate("_past", F.lit(0.0), lambda a, p: a + p[f"_c_{c}"] * F.pow(F.lit(keep[c]), start - p["_end"]))

    runs = runs.select(F.col(NAME).alias("_name"), F.col("_slice").alias("_slice2"), F.col("_run").alias("_run2"), *(carry(c).alias(f"_k_{c}") for c in terms))
    same = F.col(NAME).eqNullSafe(F.col("_name")) & F.col("_slice").eqNullSafe(F.col("_slice2")) & (F.col("_run") == F.col("_run2"))
    out = d.join(runs, same, "left")
    return out.select(*df.columns, *((F.col(f"_s_{c}") + F.col(f"_k_{c}") * weight[c]).alias(c) for c in terms))


def ewm(df: DataFrame, c: str, alpha: float, seconds: int = 30 * DAY, bias: bool = False, mean: str = "ewm_mean", std: str = "ewm_std") -> DataFrame:
    """Exponentially weighted mean and deviation over all rows of the ticker so far, weights (1 - alpha) by age in rows.

    Missing values add nothing but age the others; before the first value both are null. Values are taken from the
    ticker's first one, so that squares stay small; the deviation is unbiased unless ``bias`` (then null below two values).
    """
    x, keep = F.when(is_finite(c), F.col(c).cast("double")), 1 - alpha
    first = df.where(is_finite(c)).groupBy(F.col(NAME).alias("_of")).agg(F.min_by(F.col(c).cast("double"), TIME).alias("_first"))
    d = df.join(first, F.col(NAME).eqNullSafe(F.col("_of")), "left").drop("_of")
    off = x - F.col("_first")
    one = F.when(off.isNotNull(), 1.0)
    d = decayed_sums(d, {"_w": one, "_ww": one, "_x": off, "_xx": off * off}, {"_w": keep, "_ww": keep * keep, "_x": keep, "_xx": keep}, slice_of(seconds))
    at = safe_div("_x", "_w")
    spread = F.greatest(safe_div("_xx", "_w") - at * at, F.lit(0.0))
    rest = F.col("_w") * F.col("_w") - F.col("_ww")
    if not bias:
        spread = spread * safe_div(F.col("_w") * F.col("_w"), F.when(rest > 1e-15 * F.col("_w") * F.col("_w"), rest))
    return d.select(*df.columns, (at + F.col("_first")).alias(mean), F.sqrt(F.when(F.col("_w") > 0, spread)).alias(std))


def wilder(df: DataFrame, columns: dict[str, Column], n: int, seconds: int = 30 * DAY) -> DataFrame:
    """``df`` with Wilder's averages: the first value of a ticker, then an n-th of each value and the rest of the average.

    A column's missing values take no part: they get null and the recursion passes over them; columns share their rows,
    so a row where one of them is missing is passed over for all.
    """
    d = df.withColumns({f"_v_{c}": x.cast("double") for c, x in columns.items()})
    there = F.lit(True)
    for c in columns:
        there = there & is_finite(f"_v_{c}")
    rows = d.where(there)
    first = rows.groupBy(F.col(NAME).alias("_of")).agg(F.min(TIME).alias("_start"))
    rows = rows.join(first, F.col(NAME).eqNullSafe(F.col("_of")), "left")
    share = F.when(F.col(TIME) == F.col("_start"), 1.0).otherwise(1 / n)
    found = decayed_sums(rows, {c: F.col(f"_v_{c}") * share for c in columns}, dict.fromkeys(columns, 1 - 1 / n), slice_of(seconds))
    rest = d.where(~there).select(*df.columns, *(F.lit(None).cast("double").alias(c) for c in columns))
    return found.select(*df.columns, *columns).unionByName(rest)


def smoothed(df: DataFrame, columns: dict[str, Column], n: int) -> DataFrame:
    """``wilder`` for frames whose other steps order each ticker's rows in one task anyway, such as lags: windows by ticker only.

    Rows are cut into runs by their number; what came before a run is below 1e-200 of its weight at the run's end, so a run
    takes over one value, the end of the run before. Nothing is joined and, once rows lie by ticker, nothing is shuffled.
    """
    keep = 1 - 1 / n
    if not columns or not 0 < keep < 1:
        raise ValueError("a recursion needs terms that keep a share between 0 and 1")
    size = max(1, int(200 / -math.log10(keep)))
    d = df.withColumns({f"_v_{c}": x.cast("double") for c, x in columns.items()})
    there = F.lit(True)
    for c in columns:
        there = there & is_finite(f"_v_{c}")
    upto = Window.partitionBy(NAME).orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_there", there).withColumn("_k", F.sum(F.col("_there").cast("long")).over(upto))
    d = d.withColumn("_run", F.floor((F.col("_k") - 1) / size)).withColumn("_at", F.pmod(F.col("_k") - 1, F.lit(size)) + 1)
    within = Window.partitionBy(NAME, "_run").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(NAME).orderBy(TIME, "_k").rowsBetween(Window.unboundedPreceding, -1)
    weight, share = F.pow(F.lit(keep), F.col("_at")), F.when(F.col("_k") == 1, 1.0).otherwise(1 / n)
    d = d.withColumns({f"_s_{c}": F.sum(F.when(F.col("_there"), F.col(f"_v_{c}") * share / weight)).over(within) * weight for c in columns})
    ends = F.col("_there") & (F.col("_at") == size)
    d = d.withColumns({f"_c_{c}": F.last(F.when(ends, F.col(f"_s_{c}")), ignorenulls=True).over(before) for c in columns})
    return d.select(*df.columns, *(F.when(F.col("_there"), F.col(f"_s_{c}") + F.coalesce(F.col(f"_c_{c}"), F.lit(0.0)) * weight).alias(c) for c in columns))


def adx(df: DataFrame, high: str, low: str, close: str, n: int = 14, seconds: int | None = None) -> DataFrame:
    """Directional movement of a ticker by Wilder's smoothing: plus_di, minus_di and adx, null on its first rows.

    All steps run along the ticker on one shuffle; with ``seconds``, the recursions are spread over time slices of that
    length, at the price of many more shuffles.
    """
    own = Window.partitionBy(NAME).orderBy(TIME)
    up, down, before = F.col(high) - F.lag(high).over(own), F.lag(low).over(own) - F.col(low), F.lag(close).over(own)
    d = df.withColumns({"_up": up, "_down": down, "_before": before})
    zero = F.lit(0.0)
    moves = {
        "_plus": F.when((F.col("_up") > F.col("_down")) & (F.col("_up") > 0), F.col("_up")).when(F.col("_up").isNotNull() & F.col("_down").isNotNull(), zero),
        "_minus": F.when((F.col("_down") > F.col("_up")) & (F.col("_down") > 0), F.col("_down")).when(F.col("_up").isNotNull() & F.col("_down").isNotNull(), zero),
        "_range": F.when(F.col("_before").isNotNull(), F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - F.col("_before")), F.abs(F.col(low) - F.col("_before")))),
    }
    smooth = smoothed if seconds is None else partial(wilder, seconds=seconds)
    d = smooth(d, moves, n)
    d = d.withColumn("plus_di", 100 * safe_div("_plus", "_range")).withColumn("minus_di", 100 * safe_div("_minus", "_range"))
    index = F.when(F.col("plus_di").isNotNull(), 100 * safe_div(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di"), 0.0))
    return smooth(d, {"adx": index}, n).select(*df.columns, "plus_di", "minus_di", "adx")


def hysteresis(df: DataFrame, c: str, enter: float, leave: float, name: str = "regime") -> DataFrame:
    """1 from a value of ``enter`` or more on until one of ``leave`` or less, else 0; it starts as 0 and missing values keep it.

    A value outside the band decides by itself, so the state is the last such decision: no loop along the ticker.
    """
    if not leave < enter:
        raise ValueError("leave must lie below enter")
    said = F.when(F.col(c) >= enter, 1).when(F.col(c) <= leave, 0)
    past = Window.partitionBy(NAME).orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.coalesce(F.last(said, ignorenulls=True).over(past), F.lit(0)))
