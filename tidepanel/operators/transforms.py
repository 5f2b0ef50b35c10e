"""Transforms that signals are built from. All look back only, unless their name says cross-section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import NAME, TIME, avg_rank, bar, own, safe_div


def momentum(c: str, k: int) -> Column:
    return safe_div(F.col(c), F.lag(c, k).over(own()), None) - 1


def relative_volume(c: str, n: int) -> Column:
    """Value against the mean of the n rows before."""
    return safe_div(c, F.avg(c).over(own(n, -1)))


def log_shock(c: str, n: int) -> Column:
    """Log ratio to the median of the n rows before."""
    median = F.expr(f"percentile({c}, 0.5) over (partition by {NAME} order by {TIME} rows between {n} preceding and 1 preceding)")
    return F.when((F.col(c) > 0) & (median > 0), F.log(F.col(c) / median))


def ts_zscore(c: str, n: int) -> Column:
    w = own(n - 1)
    s = F.stddev_samp(c).over(w)
    return safe_div(F.col(c) - F.avg(c).over(w), F.when(s > 0, s))


def ts_rank(c: str, n: int) -> Column:
    """Share of the last n values that are at most this one."""
    x = F.collect_list(c).over(own(n - 1))
    return F.size(F.filter(x, lambda v: v <= F.col(c))) / F.size(x)


def ewm_mean(c: str, alpha: float, n: int) -> Column:
    """Exponentially weighted mean over the last n rows, weights normalised over those there are."""
    x = F.reverse(F.collect_list(c).over(own(n - 1)))
    weight = F.transform(x, lambda v, k: F.pow(F.lit(1 - alpha), k))
    top = F.aggregate(F.zip_with(x, weight, lambda v, u: v * u), F.lit(0.0), lambda a, b: a + b)
    return safe_div(top, F.aggregate(weight, F.lit(0.0), lambda a, b: a + b))


def ewm_std(c: str, alpha: float, n: int) -> Column:
    """Exponentially weighted deviation from the weighted mean, over the same rows as ``ewm_mean``."""
    x = F.reverse(F.collect_list(c).over(own(n - 1)))
    weight = F.transform(x, lambda v, k: F.pow(F.lit(1 - alpha), k))
    total = F.aggregate(weight, F.lit(0.0), lambda a, b: a + b)
    # the mean goes in as an array of one, so that it is computed once a row
    off = F.flatten(F.transform(F.array(ewm_mean(c, alpha, n)), lambda mean: F.transform(x, lambda v: v - mean)))
    top = F.aggregate(F.zip_with(off, weight, lambda v, u: u * v * v), F.lit(0.0), lambda a, b: a + b)
    return F.sqrt(safe_div(top, total))


def _median(x: Column) -> Column:
    """Median of an array without nulls; null where it is empty."""
    s, n = F.sort_array(x), F.size(x)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def mad(c: str, n: int) -> Column:
    """Median absolute deviation from the median of the last n rows."""
    x = F.collect_list(c).over(own(n - 1))
    return _median(F.flatten(F.transform(F.array(_median(x)), lambda m: F.transform(x, lambda v: F.abs(v - m)))))


def trailing_quantile(c: str, n: int, q: float) -> Column:
    return F.expr(f"percentile({c}, {q}) over (partition by {NAME} order by {TIME} rows between {n - 1} preceding and current row)")


def market_relative_vol(df: DataFrame, c: str, n: int) -> DataFrame:
    """Realized volatility against its mean over the bar."""
    return df.withColumn("vol", realized_vol(c, n)).withColumn("market_relative_vol", safe_div("vol", F.avg("vol").over(bar())))


def realized_vol(c: str, n: int) -> Column:
    return F.stddev_samp(c).over(own(n - 1))


def downside_vol(c: str, n: int) -> Column:
    return F.stddev_samp(F.when(F.col(c) < 0, F.col(c))).over(own(n - 1))


def vol_of_vol(df: DataFrame, c: str, n: int) -> DataFrame:
    return df.withColumn("vol", realized_vol(c, n)).withColumn("vol_of_vol", F.stddev_samp("vol").over(own(n - 1)))


def market_return(names: list[str], c: str = "return") -> Column:
    """Mean return of the named tickers, on every row of the bar."""
    return F.avg(F.when(F.col(NAME).isin(names), F.col(c))).over(bar())


def rolling_beta(y: str, x: str, n: int) -> Column:
    """Slope of y on x over the n rows before; null where x does not vary."""
    w = own(n, -1)
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    a, b = F.when(both, F.col(y)), F.when(both, F.col(x))
    v = F.var_pop(b).over(w)
    return safe_div(F.covar_pop(a, b).over(w), F.when(v > 1e-18, v))


def residualize(y: str, x: str) -> Column:
    """Residual of the bar's regression of y on one exposure and a constant."""
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    a, b = F.when(both, F.col(y)), F.when(both, F.col(x))
    v = F.var_pop(b).over(bar())
    slope = safe_div(F.covar_pop(a, b).over(bar()), F.when(v > 1e-18, v), 0.0)
    return a - F.avg(a).over(bar()) - slope * (b - F.avg(b).over(bar()))


def max_return(c: str, n: int) -> Column:
    return F.max(c).over(own(n - 1))


def topk_mean(c: str, n: int, k: int) -> Column:
    top = F.slice(F.sort_array(F.collect_list(c).over(own(n - 1)), asc=False), 1, k)
    return safe_div(F.aggregate(top, F.lit(0.0), lambda a, b: a + b), F.size(top))


def bollinger(c: str, n: int, width: float = 2.0) -> Column:
    return ts_zscore(c, n) / width


def rsi(df: DataFrame, c: str, n: int) -> DataFrame:
    d = df.withColumn("step", F.col(c) - F.lag(c).over(own()))
    up, down = (F.avg(F.greatest(s * F.col("step"), F.lit(0.0))).over(own(n - 1)) for s in (1, -1))
    return d.withColumn("rsi", F.when(F.col("step").isNotNull(), F.coalesce(safe_div(100 * up, up + down), F.lit(50.0))))


def ar1_speed(df: DataFrame, c: str, n: int) -> DataFrame:
    """One less the slope of a value on its predecessor over the last n rows."""
    d = df.withColumn("before", F.lag(c).over(own()))
    both = F.col(c).isNotNull() & F.col("before").isNotNull()
    x, y = F.when(both, F.col("before")), F.when(both, F.col(c))
    v = F.var_pop(x).over(own(n - 1))
    return d.withColumn("ar1_speed", 1 - safe_div(F.covar_pop(x, y).over(own(n - 1)), F.when(v > 1e-18, v)))


def rolling_corr(x: str, y: str, n: int) -> Column:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b, w = F.when(both, F.col(x)), F.when(both, F.col(y)), own(n - 1)
    s = F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)
    return safe_div(F.covar_pop(a, b).over(w), F.when(s > 1e-18, s))


def corr_change(df: DataFrame, x: str, y: str, n: int) -> DataFrame:
    """Rolling correlation less its value n rows ago, and how much it varied over the last n rows."""
    d = df.withColumn("corr", rolling_corr(x, y, n))
    return d.withColumn("change", F.col("corr") - F.lag("corr", n).over(own())).withColumn("stability", F.stddev_samp("corr").over(own(n - 1)))


def rolling_rank_corr(x: str, y: str, n: int) -> Column:
    """Correlation of the ranks within the last n rows that have both values; ties share their mean rank."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    rows = F.collect_list(F.when(both, F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).over(own(n - 1))

    def centred(side: str) -> Column:
        # values below less values above: twice the mean rank, less a constant
        return F.transform(rows, lambda a: F.aggregate(rows, F.lit(0.0), lambda t, b: t + F.signum((a[side] - b[side]).cast("double"))))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda t, v: t + v)

    def corr(s: Column) -> Column:
        spread = F.sqrt(dot(s["a"], s["a"]) * dot(s["b"], s["b"]))
        return safe_div(dot(s["a"], s["b"]), F.when(spread > 0, spread))

    # an array of one, so that the ranks are computed once a row
    return F.get(F.transform(F.array(F.struct(centred("x").alias("a"), centred("y").alias("b"))), corr), F.lit(0))


def amihud(n: int, c: str = "return", price: str = "close", volume: str = "volume", scale: float = 1e6) -> Column:
    """Mean absolute return by traded value over the last n rows, for ``scale`` of value."""
    return scale * F.avg(safe_div(F.abs(c), F.col(price) * F.col(volume))).over(own(n - 1))


def flow_ratio(part: str, whole: str, n: int) -> Column:
    """Share of one flow (such as taker volume) in another over the last n rows."""
    w = own(n - 1)
    return safe_div(F.sum(part).over(w), F.sum(whole).over(w))


def volume_clock(df: DataFrame, c: str = "volume") -> DataFrame:
    """Running volume of the ticker, its velocity (this row) and acceleration."""
    total = F.sum(c).over(Window.partitionBy(NAME).orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("clock", total).withColumn("acceleration", F.col(c) - F.lag(c).over(own()))


def slot_mean(c: str, slot: Column) -> Column:
    """Mean of the ticker's earlier rows in the same slot."""
    w = Window.partitionBy(NAME, slot).orderBy(TIME).rowsBetween(Window.unboundedPreceding, -1)
    return F.avg(c).over(w)


def vwap_dev(n: int, price: str = "close", volume: str = "volume") -> Column:
    w = own(n - 1)
    return safe_div(price, safe_div(F.sum(F.col(price) * F.col(volume)).over(w), F.sum(volume).over(w))) - 1


def regime_blend(df: DataFrame, calm: str, wild: str, c: str = "return", n: int = 20) -> DataFrame:
    """``calm`` where the bar's mean volatility is at most its trailing mean over bars, else ``wild``."""
    d = df.withColumn("vol", realized_vol(c, n))
    bars = d.groupBy(TIME).agg(F.avg("vol").alias("bar_vol"))
    bars = bars.withColumn("high", F.col("bar_vol") > F.avg("bar_vol").over(Window.orderBy(TIME).rowsBetween(-n, -1)))
    return d.join(bars.select(TIME, "high"), TIME).withColumn("blend", F.when(F.col("high"), F.col(wild)).otherwise(F.col(calm)))


def cs_rank(c: str) -> Column:
    """Average rank within the bar, scaled to 0..1."""
    n = F.count(c).over(bar())
    return F.when(n > 1, (avg_rank(c, TIME) - 1) / (n - 1)).otherwise(0.5)


def wide(df: DataFrame, value: str, names: list[str] | None = None, order: str | None = None, most: int = 10_000) -> DataFrame:
    """A row per bar with a column per ticker, null where it has no row.

    The tickers are the given ones, or all (sorted; more than ``most`` are an error, as columns must be few). Of several
    rows of a bar and ticker the first in ``order`` counts, without one any of them.
    """
    if names is None:
        names = sorted(r[0] for r in df.select(NAME).where(F.col(NAME).isNotNull()).distinct().limit(most + 1).collect())
        if len(names) > most:
            raise ValueError(f"more than {most} tickers")
    picked = F.min_by(value, order) if order else F.first(value)
    return df.groupBy(TIME).pivot(NAME, names).agg(picked) if names else df.select(TIME).distinct()


def winsorize(c: str, low: float = 0.05, high: float = 0.95) -> Column:
    """Clipped to percentiles of the bar."""
    p = F.expr(f"percentile({c}, array({low}, {high})) over (partition by {TIME})")
    return F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), p[0]), p[1]))


def imbalance(a: str, b: str) -> Column:
    return safe_div(F.col(a) - F.col(b), F.col(a) + F.col(b), 0.0)


def premium(df: DataFrame, a: str, b: str, limit: float = 10.0) -> DataFrame:
    """Percent premium of a over b within the limit, known one row late, with its change and acceleration."""
    raw = F.least(F.greatest(safe_div((F.col(a) - F.col(b)) * 100, F.col(b)), F.lit(-limit)), F.lit(limit))
    d = df.withColumn("_raw", raw).withColumn("premium", F.lag("_raw").over(own())).drop("_raw")
    d = d.withColumn("change", F.col("premium") - F.lag("premium").over(own()))
    return d.withColumn("acceleration", F.col("change") - F.lag("change").over(own()))


def walk_forward(df: DataFrame, y: str, x: str, block: Column, ridge: float = 0.0) -> DataFrame:
    """Prediction of y from x by a regression over all rows of earlier blocks; ``ridge`` penalises the squared slope.

    Moments are summed per block; only block rows meet in the running window, then join back.
    """
    d = df.withColumn("block", block)
    ok = d.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    a, b = F.col(x), F.col(y)
    m = ok.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"))
    blocks = d.select("block").distinct().join(m, "block", "left")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    run = blocks.select("block", *(F.sum(c).over(before).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")))
    var = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx") + F.col("n") * F.lit(ridge)
    run = run.withColumn("slope", safe_div(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.when(var > 1e-18, var)))
    run = run.withColumn("icept", safe_div(F.col("sy") - F.col("slope") * F.col("sx"), "n"))
    return d.join(run.select("block", "slope", "icept"), "block").withColumn("predicted", F.col("icept") + F.col("slope") * F.col(x))


def cluster_spread(df: DataFrame, c: str, k: int = 4, seed: int = 1) -> DataFrame:
    """Distance of c from the mean of the bar's tickers of the same cluster; tickers cluster by return moments."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    per = df.where(F.col("return").isNotNull()).groupBy(NAME).agg((F.avg("return") * 1e3).alias("m"), (F.stddev_pop("return") * 1e3).alias("s"))
    rows = VectorAssembler(inputCols=["m", "s"], outputCol="features").transform(per)
    of = KMeans(k=k, seed=seed).fit(rows).transform(rows).select(NAME, F.col("prediction").alias("cluster"))
    d = df.join(of, NAME)
    return d.withColumn("spread", F.col(c) - F.avg(c).over(Window.partitionBy(TIME, "cluster")))


def asof_daily(hourly: DataFrame, daily: DataFrame, columns: list[str], days: int = 1) -> DataFrame:
    """Last known daily values of a ticker, usable ``days`` days late, on hourly rows (an as-of join by union and window)."""
    late = daily.select(NAME, (F.col(TIME) + F.expr(f"interval {days} day")).alias(TIME), *columns, F.lit(0).alias("_kind"))
    rows = hourly.withColumn("_kind", F.lit(1)).unionByName(late, allowMissingColumns=True)
    w = Window.partitionBy(NAME).orderBy(TIME, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    return rows.where("_kind = 1").drop("_kind")
