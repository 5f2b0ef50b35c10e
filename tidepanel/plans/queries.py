"""Panel queries over the driver's tables, and the same in SQL.

A query is a frame, the SQL body over shared derivations, and a digest: ``name:kind`` for its columns,
kinds t (time, as epoch seconds), d (number, rounded), l (whole number), s (text), b (boolean), a (date).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import (
    KEYS, NAME, TIME, any_of, avg_rank, bar, clip, closed_range, is_finite, lcg_noise, own, qcut_bucket, rank_quintile, safe_div, stripe_ordinal, with_row_index,
)
from ..operators import backtest as B
from ..operators import features as X
from ..operators import peers as N
from ..operators import portfolio as P
from ..operators import regression as L
from ..operators import scan as E
from ..operators import snapshots as C
from ..operators import scoring as M
from ..operators import splits as S
from ..operators import stats as G
from ..operators import transforms as T
from ..sources import panel as A
from ..sources import sinks as K
from ..streaming.scores import bar_scores
from .panel_sql import BACKTEST, IC, PANEL_D, PANEL_H, SCORED, SIGNAL, STREAMS, average_rank, bucket, corr

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CUT_D, CUT_H = datetime(2000, 1, 1), datetime(2024, 1, 22)
DIGITS = 7


def _digest(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for part in spec.split():
        name, kind = part.split(":")
        c = F.col(name)
        out.append({
            "t": F.unix_timestamp(c).alias("bar" if name == TIME else name), "d": (F.round(c.cast("double"), DIGITS) + F.lit(0.0)).alias(name), "l": c.cast("long").alias(name),
            "s": c.cast("string").alias(name), "b": c.alias(name), "a": c.cast("date").cast("string").alias(name),
        }[kind])
    return df.select(*out)


def _digest_sql(spec: str) -> str:
    out = []
    for part in spec.split():
        name, kind = part.split(":")
        q = f'"{name}"'
        out.append({
            "t": f"epoch({q})::BIGINT AS " + ("bar" if name == TIME else q), "d": f"round({q}::DOUBLE, {DIGITS}) + 0.0 AS {q}", "l": f"{q}::BIGINT AS {q}",
            "s": f"{q}::VARCHAR AS {q}", "b": f"{q} AS {q}", "a": f"{q}::DATE::VARCHAR AS {q}",
        }[kind])
    return ", ".join(out)


def _with(*parts: str) -> str:
    return ",\n".join(parts)


D, H = _with(PANEL_D), _with(PANEL_H)
DS, HS = _with(PANEL_D, SIGNAL), _with(PANEL_H, SIGNAL)
DC, HC = _with(DS, SCORED), _with(HS, SCORED)
DB, HB = _with(DS, BACKTEST), _with(HS, BACKTEST)
DP = _with(PANEL_D, STREAMS)
ON = "PARTITION BY ticker ORDER BY timestamp_agg"


def add(name: str, frame: Query, spec: str, ctes: str | None = None, body: str = "") -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _digest(frame(spark, sf_dir), spec)

    QUERIES[name] = query
    if ctes is not None:
        SQL[name] = f"WITH {ctes},\nq AS ({body})\nSELECT {_digest_sql(spec)} FROM q"


def reversal(panel: DataFrame) -> DataFrame:
    """Candidate: minus the last residual return."""
    return panel.select(*KEYS, (-F.lag("residual_return").over(own())).alias("signal"))


def d(spark, sf):
    return A.daily(spark, sf)


def h(spark, sf):
    return A.hourly(spark, sf)


def sig(panel):
    return X.normalised(reversal(panel))


def raw(panel):
    """The panel with the candidate as a column, so that nothing joins it with itself."""
    return panel.withColumn("signal", -F.lag("residual_return").over(own()))


def sc(panel):
    return X.normalised(G.scored(raw(panel)))


def bt(panel):
    return B.backtest_bars(X.normalised(raw(panel)))


def decay(panel, dialect="engine"):
    return G.decay_of(X.normalised(G.with_ahead(raw(panel), dialect, "residual_return", "signal")), dialect)


def on(source: Callable, f: Callable) -> Query:
    return lambda spark, sf: f(source(spark, sf))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information coefficient per hourly bar of a reversal signal."""
    return QUERIES["ic_per_bar"](spark, sf_dir)


# sources, projection, filters
add("scan_panel", d, "timestamp_agg:t ticker:s close:d volume:d n_obs:l return:d residual_return:d", D, "SELECT * FROM panel")
add("task_full", on(d, lambda p: A.full_of(p, F.col(TIME) < CUT_D, F.col(TIME) >= datetime(1999, 6, 1))), "timestamp_agg:t ticker:s close:d", D, "SELECT DISTINCT * FROM (SELECT * FROM panel WHERE timestamp_agg < '2000-01-01' UNION ALL SELECT * FROM panel WHERE timestamp_agg >= '1999-06-01')")
add("project_cols", on(h, lambda p: p.withColumnRenamed("close", "price").drop("volume").select(*KEYS, "price")), "timestamp_agg:t ticker:s price:d", H, "SELECT timestamp_agg, ticker, close AS price FROM panel")
add("finite_filter", on(d, lambda p: p.where(is_finite("residual_return")).select(*KEYS, "residual_return")), "timestamp_agg:t ticker:s residual_return:d", D, "SELECT timestamp_agg, ticker, residual_return FROM panel WHERE residual_return IS NOT NULL AND NOT isnan(residual_return) AND isfinite(residual_return)")
add("fill_values", on(d, lambda p: p.select(*KEYS, F.coalesce(F.nanvl("return", F.lit(0.0)), F.lit(0.0)).alias("filled"))), "timestamp_agg:t ticker:s filled:d", D, 'SELECT timestamp_agg, ticker, coalesce("return", 0) AS filled FROM panel')
add("drop_nulls", on(d, lambda p: p.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in p.columns))).select(*KEYS, "return")), "timestamp_agg:t ticker:s return:d", D, 'SELECT * FROM panel WHERE "return" IS NOT NULL AND residual_return IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL')
add("case_when", on(d, lambda p: p.select(*KEYS, F.when(F.col(TIME) >= CUT_D, F.lit(None).cast("double")).otherwise(F.col("return")).alias("masked"))), "timestamp_agg:t ticker:s masked:d", D, "SELECT timestamp_agg, ticker, CASE WHEN timestamp_agg >= '2000-01-01' THEN NULL ELSE \"return\" END AS masked FROM panel")
add("clip", on(d, lambda p: p.select(*KEYS, clip(F.col("residual_return") * 1000, -4.0, 4.0).alias("clipped"))), "timestamp_agg:t ticker:s clipped:d", D, "SELECT timestamp_agg, ticker, CASE WHEN residual_return IS NOT NULL THEN least(greatest(residual_return * 1000, -4), 4) END AS clipped FROM panel")
add("any_of", on(h, lambda p: p.where(any_of(NAME, ["click", "error", "signup"])).select(*KEYS, "close")), "timestamp_agg:t ticker:s close:d", H, "SELECT * FROM panel WHERE ticker IN ('click', 'error', 'signup')")
add("row_index", on(d, lambda p: with_row_index(p).select(*KEYS, "row")), "timestamp_agg:t ticker:s row:l", D, "SELECT *, row_number() OVER (ORDER BY ticker, timestamp_agg) - 1 AS row FROM panel")
add("range_mask", on(d, lambda p: p.where(closed_range(TIME, datetime(1998, 1, 1), datetime(1998, 12, 31))).select(*KEYS, "close")), "timestamp_agg:t ticker:s close:d", D, "SELECT * FROM panel WHERE timestamp_agg BETWEEN '1998-01-01' AND '1998-12-31'")
add("stripe_mask", on(d, lambda p: p.select(*KEYS, (F.pmod(stripe_ordinal(TIME, "week"), F.lit(2)) == 1).alias("hit"))), "timestamp_agg:t ticker:s hit:b", D, "SELECT *, (year(timestamp_agg) * 53 + week(timestamp_agg)) % 2 = 1 AS hit FROM panel")

# joins, sets, selection
add("join_same_bar", on(d, lambda p: sc(p).select(*KEYS, "signal", "ret")), "timestamp_agg:t ticker:s signal:d ret:d", DC, "SELECT * FROM sc")
add("join_aligned", on(d, lambda p: G.scored(sig(p).withColumn(TIME, F.col(TIME).cast("string")), p).select(*KEYS, "signal", "ret")), "timestamp_agg:t ticker:s signal:d ret:d", DC, "SELECT * FROM sc")
add("join_next_bar", on(h, lambda p: sc(p).select(*KEYS, "signal", "ret_next")), "timestamp_agg:t ticker:s signal:d ret_next:d", HC, "SELECT * FROM sc")


def _view(p: DataFrame, cut: datetime, mode: str = "null") -> DataFrame:
    return X.view(p.where(F.col(TIME) < cut), p.where(F.col(TIME) >= cut), mode)


add("period_filter", on(d, lambda p: X.period(reversal(p), _view(p, CUT_D))), "timestamp_agg:t ticker:s signal:d", DS, "SELECT * FROM raw WHERE timestamp_agg >= '2000-01-01'")
add("align_panels", lambda s, sf: (lambda p: p.where(F.month(TIME) % 2 == 0).select(*KEYS, "close").join(p.where(F.dayofmonth(TIME) <= 15).select(TIME).distinct(), TIME, "left_semi").join(p.where(F.col("volume") > 60).select(NAME).distinct(), NAME, "left_semi"))(d(s, sf)), "timestamp_agg:t ticker:s close:d", D, "SELECT * FROM panel WHERE month(timestamp_agg) % 2 = 0 AND timestamp_agg IN (SELECT timestamp_agg FROM panel WHERE day(timestamp_agg) <= 15) AND ticker IN (SELECT ticker FROM panel WHERE volume > 60)")
add("validation_ordinal", on(d, lambda p: p.select(stripe_ordinal(TIME, "month").alias("unit")).distinct().withColumn("ordinal", F.row_number().over(Window.orderBy("unit")) - 1)), "unit:l ordinal:l", D, "SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS ordinal FROM (SELECT DISTINCT year(timestamp_agg) * 12 + month(timestamp_agg) AS unit FROM panel)")


def _delta(p: DataFrame) -> DataFrame:
    other = p.where("volume > 20").select(*KEYS, (F.lag("residual_return").over(own()) * -1.0 + F.when(F.col(NAME) == "S1", 1e-3).otherwise(0.0)).alias("signal"))
    return X.delta(reversal(p).where("signal is not null"), other.where("signal is not null"))


add("signal_delta", on(d, _delta), "shared:l max_delta:d changed:l missing:l", DS, f"SELECT count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS shared, coalesce(max(abs(l - r)), 0) AS max_delta, count(*) FILTER (abs(l - r) > 1e-8) AS changed, greatest(count(l), count(r)) - count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS missing FROM (SELECT timestamp_agg, ticker, signal AS l FROM raw WHERE signal IS NOT NULL) FULL JOIN (SELECT timestamp_agg, ticker, -lag(residual_return) OVER ({ON}) + CASE WHEN ticker = 'S1' THEN 1e-3 ELSE 0 END AS r FROM panel WHERE volume > 20 QUALIFY r IS NOT NULL) USING (timestamp_agg, ticker)")
add("union_diag", lambda s, sf: h(s, sf).select(*KEYS, "close", "n_obs").unionByName(d(s, sf).select(*KEYS, "volume", F.col("n_obs").cast("double").alias("n_obs")), allowMissingColumns=True), "timestamp_agg:t ticker:s close:d volume:d n_obs:d", D + ",\nhb AS (SELECT date_trunc('hour', ts) AS timestamp_agg, event_type AS ticker, avg(value) AS close, count(*) AS n_obs FROM events GROUP BY 1, 2)", "SELECT timestamp_agg, ticker, close, NULL::DOUBLE AS volume, n_obs::DOUBLE AS n_obs FROM hb UNION ALL SELECT timestamp_agg, ticker, NULL, volume, n_obs FROM panel")
add("union_strict", on(h, lambda p: p.where(F.col(TIME) < CUT_H).unionByName(p.where(F.col(TIME) >= CUT_H)).select(*KEYS, "volume")), "timestamp_agg:t ticker:s volume:d", H, "SELECT * FROM panel")
add("sorted_panel", on(h, lambda p: p.select(*KEYS, "close").orderBy(NAME, TIME)), "timestamp_agg:t ticker:s close:d", H, "SELECT * FROM panel ORDER BY ticker, timestamp_agg")
add("distinct_keys", on(d, lambda p: p.select(F.trunc(TIME, "month").alias("month"), NAME).distinct()), "month:a ticker:s", D, "SELECT DISTINCT date_trunc('month', timestamp_agg) AS month, ticker FROM panel")
add("row_slice", on(d, lambda p: p.orderBy(NAME, TIME).limit(10).select(*KEYS, "close")), "timestamp_agg:t ticker:s close:d", D, "SELECT * FROM panel ORDER BY ticker, timestamp_agg LIMIT 10")
add("distinct_bars", on(d, lambda p: p.select(TIME).distinct().orderBy(TIME)), "timestamp_agg:t", D, "SELECT DISTINCT timestamp_agg FROM panel")
add("ts_range", on(d, lambda p: p.groupBy(NAME).agg(F.min(TIME).alias("first"), F.max(TIME).alias("last"))), "ticker:s first:t last:t", D, "SELECT ticker, min(timestamp_agg) AS first, max(timestamp_agg) AS last FROM panel GROUP BY 1")
add("pivot_wide", on(h, lambda p: T.wide(p, "close", order="n_obs")), "timestamp_agg:t click:d error:d purchase:d signup:d view:d", H, "SELECT timestamp_agg, " + ", ".join(f"min(close) FILTER (ticker = '{k}') AS \"{k}\"" for k in ("click", "error", "purchase", "signup", "view")) + " FROM panel GROUP BY 1")

# windows
_lag = lambda c: ", ".join(f"lag({c}, {k}) OVER ({ON}) AS {c}_lag{k}" for k in X.LAGS)
_lagspec = lambda c: " ".join(f"{c}_lag{k}:d" for k in X.LAGS)
add("safe_lags", on(d, lambda p: X.with_lags(p, ["residual_return"])), "timestamp_agg:t ticker:s " + _lagspec("residual_return"), D, f"SELECT *, {_lag('residual_return')} FROM panel")
add("lead_returns", on(d, lambda p: X.with_leads(p, "residual_return", (1, 6, 24))), "timestamp_agg:t ticker:s residual_return_lead1:d residual_return_lead6:d residual_return_lead24:d", D, "SELECT *, " + ", ".join(f"lead(residual_return, {k}) OVER ({ON}) AS residual_return_lead{k}" for k in (1, 6, 24)) + " FROM panel")
add("momentum_24", on(h, lambda p: p.select(*KEYS, F.coalesce(T.momentum("close", 24), F.lit(0.0)).alias("momentum"))), "timestamp_agg:t ticker:s momentum:d", H, f"SELECT *, coalesce(close / nullif(lag(close, 24) OVER ({ON}), 0) - 1, 0) AS momentum FROM panel")
add("zscore_clip", on(d, sig), "timestamp_agg:t ticker:s signal:d", DS, "SELECT * FROM sig")
add("avg_rank", on(d, lambda p: p.select(*KEYS, avg_rank("n_obs", TIME).alias("rank"))), "timestamp_agg:t ticker:s rank:d", D, f"SELECT *, {average_rank('n_obs', 'timestamp_agg')} AS rank FROM panel")
add("cs_count", on(d, lambda p: p.select(*KEYS, F.count(F.lit(1)).over(bar()).alias("names"))), "timestamp_agg:t ticker:s names:l", D, "SELECT *, count(*) OVER (PARTITION BY timestamp_agg) AS names FROM panel")
_QUINT = f"least(greatest(floor((({average_rank('signal', 'timestamp_agg')}) - 1) / count(*) OVER (PARTITION BY timestamp_agg) * 5), 0), 4)::INT"
add("rank_quintile", on(d, lambda p: sig(p).withColumn("bucket", rank_quintile("signal"))), "timestamp_agg:t ticker:s bucket:l", DS, f"SELECT *, {_QUINT} AS bucket FROM sig")
add("qcut_bucket", on(d, lambda p: p.withColumn("bucket", qcut_bucket("volume", 5))), "timestamp_agg:t ticker:s bucket:l", D, f"SELECT *, {bucket('volume', 'timestamp_agg', 5)} AS bucket FROM panel")
add("time_code", on(h, lambda p: p.select(TIME).distinct().withColumn("code", F.row_number().over(Window.orderBy(TIME)) - 1)), "timestamp_agg:t code:l", H, "SELECT timestamp_agg, row_number() OVER (ORDER BY timestamp_agg) - 1 AS code FROM (SELECT DISTINCT timestamp_agg FROM panel)")
add("rolling_ic", on(h, lambda p: G.rolling_ic(G.ic_per_bar(sc(p)))), "timestamp_agg:t ic:d rolling_ic:d", _with(HC, IC), "SELECT *, avg(ic) OVER (ORDER BY timestamp_agg ROWS 167 PRECEDING) AS rolling_ic FROM ic")

# statistics
add("ic_per_bar", on(h, lambda p: G.ic_per_bar(sc(p))), "timestamp_agg:t ic:d n:l", _with(HC, IC), "SELECT * FROM ic")
add("ic_summary", on(d, lambda p: G.ic_summary(G.ic_per_bar(sc(p)))), "mean_ic:d ic_std:d ic_positive:d n_timestamps:l", _with(DC, IC), "SELECT avg(ic) AS mean_ic, stddev_pop(ic) AS ic_std, avg((ic > 0)::INT) AS ic_positive, count(*) AS n_timestamps FROM ic")
add("ic_tstat", on(d, lambda p: G.ic_tstat(G.ic_per_bar(sc(p)))), "ic_tstat:d", _with(DC, IC), "SELECT avg(ic) / (stddev_samp(ic) / sqrt(count(*))) AS ic_tstat FROM ic")
add("return_corr", on(d, lambda p: G.return_corr(sc(p))), "return_correlation:d", DC, f"SELECT {corr('signal', 'ret')} AS return_correlation FROM sc")
add("autocorr", on(d, lambda p: G.autocorr(sig(p))), "autocorrelation:d", DS, f"SELECT {corr('signal', 'before')} AS autocorrelation FROM (SELECT signal, lag(signal) OVER ({ON}) AS before FROM sig)")
_QR = f"qr AS (SELECT bucket, avg(ret_next) AS mean_return, count(*) AS n FROM (SELECT ret_next, {_QUINT} AS bucket FROM sc WHERE ret_next IS NOT NULL) GROUP BY 1)"
_QE = f"qr AS (SELECT bucket, avg(ret_next) AS mean_return, count(*) AS n FROM (SELECT ret_next, {bucket('signal', 'timestamp_agg', 5)} AS bucket FROM sc WHERE ret_next IS NOT NULL) GROUP BY 1)"
add("quantile_returns", on(d, lambda p: G.quantile_returns(sc(p))), "bucket:l mean_return:d n:l", _with(DC, _QR), "SELECT * FROM qr")
add("quantile_returns_evaluator", on(d, lambda p: G.quantile_returns(sc(p), "evaluator")), "bucket:l mean_return:d n:l", _with(DC, _QE), "SELECT * FROM qr")
add("quantile_spread", on(d, lambda p: G.quantile_spread(sc(p))), "spread:d", _with(DC, _QR), "SELECT max_by(mean_return, bucket) - min_by(mean_return, bucket) AS spread FROM qr")
add("monotonicity", on(d, lambda p: G.quantile_spread(sc(p))), "monotonicity:d", _with(DC, _QR), "SELECT corr(rx, ry) AS monotonicity FROM (SELECT rank() OVER (ORDER BY bucket) AS rx, rank() OVER (ORDER BY mean_return) AS ry FROM qr)")


def _decay_sql(hs: tuple) -> str:
    ahead = ", ".join(f"lead(residual_return, {k}) OVER ({ON}) AS h{k}" for k in hs)
    parts = " UNION ALL ".join(f"SELECT {k} AS horizon, timestamp_agg, avg(signal * h{k}) AS ic FROM sig JOIN ah USING (timestamp_agg, ticker) WHERE h{k} IS NOT NULL GROUP BY 2" for k in hs)
    return f"SELECT horizon, avg(ic) AS ic FROM (WITH ah AS (SELECT timestamp_agg, ticker, {ahead} FROM panel) {parts}) GROUP BY 1"


add("ic_decay", on(d, lambda p: decay(p)), "horizon:l ic:d", DS, _decay_sql(G.DECAY["engine"]))
add("ic_decay_evaluator", on(h, lambda p: decay(p, "evaluator")), "horizon:l ic:d", HS, _decay_sql(G.DECAY["evaluator"]))
add("ic_decay_labels", on(d, lambda p: M.decay_labels(decay(p).withColumn("ic", F.col("ic") * 10))), "horizon:l label:s", DS, "SELECT horizon, CASE WHEN abs(ic) > .0005 THEN 'Strong' WHEN abs(ic) > .0002 THEN 'Good' WHEN abs(ic) > .0001 THEN 'Moderate' WHEN abs(ic) > .00003 THEN 'Weak' ELSE 'Decayed' END AS label FROM (" + _decay_sql(G.DECAY["engine"]) + ")")


def _dk_sql(y: str) -> str:
    return f"""SELECT slope / sqrt((s00 * a * a + 2 * a * b * s01 + b * b * s11) * (bars / (bars - 1.0)) * ((n - 1.0) / (n - 2.0))) AS dk_tstat FROM (
  WITH obs AS (SELECT timestamp_agg, signal AS x, {y} AS y FROM sc WHERE {y} IS NOT NULL),
  m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, covar_pop(x, y) AS cxy, count(DISTINCT timestamp_agg) AS bars FROM obs),
  u AS (SELECT timestamp_agg, sum(e) AS u0, sum(e * x) AS u1, row_number() OVER (ORDER BY timestamp_agg) AS i FROM
        (SELECT timestamp_agg, x, y - (my - cxy / vx * mx) - cxy / vx * x AS e FROM obs, m) GROUP BY 1),
  w AS (SELECT k, CASE WHEN k = 0 THEN 1.0 ELSE 1 - k / (ceil(pow(bars, 1 / 3.0) - 1e-9) + 1) END AS w FROM m, (SELECT unnest(range(0, 60)) AS k) WHERE k <= ceil(pow(bars, 1 / 3.0) - 1e-9)),
  s AS (SELECT sum(w * p.u0 * q.u0 * CASE WHEN k = 0 THEN 1 ELSE 2 END) AS s00, sum(w * p.u1 * q.u1 * CASE WHEN k = 0 THEN 1 ELSE 2 END) AS s11,
               sum(w * CASE WHEN k = 0 THEN p.u0 * p.u1 ELSE p.u0 * q.u1 + p.u1 * q.u0 END) AS s01 FROM w, u p, u q WHERE q.i = p.i - k)
  SELECT *, cxy / vx AS slope, -mx / (n * vx) AS a, 1 / (n * vx) AS b FROM m, s)"""


add("dk_tstat", on(d, lambda p: G.dk_tstat(sc(p))), "dk_tstat:d", DC, _dk_sql("ret"))
add("dk_tstat_evaluator", on(h, lambda p: G.dk_tstat(sc(p), "evaluator")), "dk_tstat:d", HC, _dk_sql("ret_next"))
_CAL = f"cal AS (SELECT bucket, (bucket + .5) * 10 AS center, avg(ret_next) AS avg_return, count(*) AS \"count\" FROM (SELECT ret_next, {bucket('signal', 'timestamp_agg', 10)} AS bucket FROM sc WHERE ret_next IS NOT NULL) GROUP BY 1)"
add("calibration", on(d, lambda p: G.calibration(sc(p))), "bucket:l center:d avg_return:d count:l", _with(DC, _CAL), "SELECT * FROM cal")
add("calibration_fit", on(d, lambda p: G.calibration_fit(G.calibration(sc(p))).withColumn("slope", F.col("slope") * 1e4)), "slope:d intercept:d", _with(DC, _CAL), "SELECT regr_slope(avg_return, center) * 1e4 AS slope, regr_intercept(avg_return, center) AS intercept FROM cal")
add("rank_ic", on(d, lambda p: G.rank_ic(X.normalised(G.scored(raw(p), target="return")))), "timestamp_agg:t rank_ic:d n:l", DS, f"SELECT timestamp_agg, {corr('rx', 'ry')} AS rank_ic, count(*) AS n FROM (SELECT timestamp_agg, {average_rank('signal', 'timestamp_agg')} AS rx, {average_rank('ret', 'timestamp_agg')} AS ry FROM (SELECT sig.timestamp_agg, sig.signal, panel.\"return\" AS ret FROM sig JOIN panel USING (timestamp_agg, ticker)) WHERE ret IS NOT NULL) GROUP BY 1 HAVING count(*) >= 3")
add("coverage", on(d, lambda p: G.coverage(X.period(sig(p), _view(p, CUT_D)), p)), "coverage:d bar_coverage:d", DS, "SELECT count(*) / (count(DISTINCT timestamp_agg) * count(DISTINCT ticker))::DOUBLE AS coverage, count(DISTINCT timestamp_agg)::DOUBLE / (SELECT count(DISTINCT timestamp_agg) FROM panel) AS bar_coverage FROM sig WHERE timestamp_agg >= '2000-01-01'")
add("names_per_bar", on(d, lambda p: G.names_per_bar(sig(p))), "names_per_bar:d least:l most:l", D, "SELECT avg(n) AS names_per_bar, min(n) AS least, max(n) AS most FROM (SELECT count(*) AS n FROM panel GROUP BY timestamp_agg)")
add("describe_signal", on(d, lambda p: sig(p).agg(F.count("signal").alias("n"), F.avg("signal").alias("mean"), F.stddev_samp("signal").alias("std"), F.min("signal").alias("low"), F.max("signal").alias("high"))), "n:l mean:d std:d low:d high:d", DS, "SELECT count(signal) AS n, avg(signal) AS mean, stddev_samp(signal) AS std, min(signal) AS low, max(signal) AS high FROM sig")

# backtest
_BT = "timestamp_agg:t gross_returns:d net_ret:d turnover:d gross_leverage:d equity_curve:d"
add("backtest_bars", on(d, bt), _BT, DB, "SELECT * FROM bt")
add("backtest_hourly", on(h, bt), _BT, HB, "SELECT * FROM bt")
add("equity_curve", on(h, lambda p: bt(p).select(TIME, "equity_curve")), "timestamp_agg:t equity_curve:d", HB, "SELECT * FROM bt")
add("drawdown_curve", on(d, lambda p: B.drawdown(bt(p))), "timestamp_agg:t drawdown:d", DB, "SELECT *, equity_curve / greatest(max(equity_curve) OVER (ORDER BY timestamp_agg ROWS UNBOUNDED PRECEDING), 1e-8) - 1 AS drawdown FROM bt")
add("backtest_metrics", on(h, lambda p: B.metrics(bt(p))), "n_timestamps:l total_return:d CAGR:d volatility:d sharpe_net:d max_drawdown:d turnover_ann:d gross_leverage:d", HB, "SELECT count(*) AS n_timestamps, max_by(equity_curve, timestamp_agg) - 1 AS total_return, pow(max_by(equity_curve, timestamp_agg), 8760.0 / count(*)) - 1 AS \"CAGR\", stddev_samp(net_ret) * sqrt(8760) AS volatility, avg(net_ret) * sqrt(8760) / stddev_samp(net_ret) AS sharpe_net, min(dd) AS max_drawdown, avg(turnover) * 8760 AS turnover_ann, avg(gross_leverage) AS gross_leverage FROM (SELECT *, equity_curve / greatest(max(equity_curve) OVER (ORDER BY timestamp_agg ROWS UNBOUNDED PRECEDING), 1e-8) - 1 AS dd FROM bt)")
add("turnover_daily", on(h, lambda p: bt(p).groupBy(F.to_date(TIME).alias("date")).agg(F.sum("turnover").alias("turnover"))), "date:a turnover:d", HB, "SELECT timestamp_agg::DATE AS date, sum(turnover) AS turnover FROM bt GROUP BY 1")
add("daily_pnl", on(h, lambda p: B.daily_pnl(bt(p))), "date:a daily_ret:d", HB, "SELECT * FROM daily")
add("daily_sharpe", on(h, lambda p: B.daily_sharpe(B.daily_pnl(bt(p)))), "sharpe:d", HB, "SELECT avg(daily_ret) * sqrt(365) / stddev_samp(daily_ret) AS sharpe FROM daily")
add("equity_compound", on(h, lambda p: B.compounded(B.daily_pnl(bt(p)))), "date:a equity:d drawdown:d", HB, "SELECT date, equity, (equity - max(equity) OVER o) / (max(equity) OVER o + 1e-8) AS drawdown FROM (SELECT date, exp(sum(ln(1 + daily_ret)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS equity FROM daily) WINDOW o AS (ORDER BY date ROWS UNBOUNDED PRECEDING)")

# feature views and gate
_F = "timestamp_agg:t ticker:s is_prediction_period:b residual_return:d residual_return_lag1:d residual_return_lag24:d return_lag3:d"
_FSQL = f'SELECT timestamp_agg, ticker, timestamp_agg >= \'2000-01-01\' AS is_prediction_period, MASK AS residual_return, lag(residual_return) OVER ({ON}) AS residual_return_lag1, lag(residual_return, 24) OVER ({ON}) AS residual_return_lag24, lag("return", 3) OVER ({ON}) AS return_lag3 FROM panel'
add("feature_strict", on(d, lambda p: _view(p, CUT_D)), _F, D, _FSQL.replace("MASK", "CASE WHEN timestamp_agg < '2000-01-01' THEN residual_return END"))
add("feature_full", on(d, lambda p: _view(p, CUT_D, "raw")), _F, D, _FSQL.replace("MASK", "residual_return"))
add("mask_lagged", on(d, lambda p: _view(p, CUT_D, "lagged")), _F, D, _FSQL.replace("MASK", f"CASE WHEN timestamp_agg < '2000-01-01' THEN residual_return ELSE lag(residual_return) OVER ({ON}) END"))
add("feature_hidden", on(d, lambda p: X.view(None, p.where(F.col(TIME) >= CUT_D))), _F, D + ",\nhid AS (SELECT * FROM panel WHERE timestamp_agg >= '2000-01-01')", _FSQL.replace("MASK", "NULL::DOUBLE").replace("FROM panel", "FROM hid"))


def _hidden(p: DataFrame) -> DataFrame:
    return p.where(F.col(TIME) >= CUT_H)


def _gate(p: DataFrame, **kw) -> DataFrame:
    hid = _hidden(p)
    at = X.gate_bars(hid)[0]
    kw = {k: (X.sentinels(hid, at) if k == "future" else v) for k, v in kw.items()}
    return X.gate_view(p.where(F.col(TIME) < CUT_H), hid, at, **kw)


_GB = _with(H, "hid AS (SELECT * FROM panel WHERE timestamp_agg >= '2024-01-22')", "gb AS (SELECT timestamp_agg AS g FROM (SELECT DISTINCT timestamp_agg FROM hid) ORDER BY 1 LIMIT 1 OFFSET 1)")
add("gate_bars", lambda s, sf: (lambda p: s.createDataFrame([(t,) for t in X.gate_bars(_hidden(p), 3)], f"{TIME} timestamp"))(h(s, sf)), "timestamp_agg:t", _with(H, "b AS (SELECT timestamp_agg, row_number() OVER (ORDER BY timestamp_agg) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT timestamp_agg FROM panel WHERE timestamp_agg >= '2024-01-22'))"), "SELECT timestamp_agg FROM b WHERE i IN (1, n // 2, n - 2)")
_G = "timestamp_agg:t ticker:s is_prediction_period:b residual_return:d residual_return_lag1:d"
_GSQL = "SELECT timestamp_agg, ticker, timestamp_agg = g AS is_prediction_period, CASE WHEN timestamp_agg < g THEN residual_return END AS residual_return, {lag} AS residual_return_lag1 FROM panel, gb WHERE {keep}".format(lag=f"lag(residual_return) OVER ({ON})", keep="timestamp_agg <= g")
add("gate_view", on(h, lambda p: _gate(p)), _G, _GB, _GSQL)
_GE = _GB + ",\nse AS (SELECT min(timestamp_agg) AS a, max(timestamp_agg) AS b FROM panel, gb WHERE timestamp_agg > g)"
_NOISE = "((((row_number() OVER (ORDER BY ticker, timestamp_agg) - 1) * 1103515245::BIGINT + 12345) % 2000000) / 1e6 - 1) * 0.25"


def _gate_sql(kind: str) -> str:
    """A gate view: ``kind`` is base, current (noise at the bar) or future (noise at the first and last bar after it)."""
    at = _NOISE if kind == "current" else "NULL::DOUBLE"
    rows = "SELECT panel.*, g FROM panel, gb, se WHERE timestamp_agg <= g" + (" OR timestamp_agg IN (a, b)" if kind == "future" else "")
    return f"SELECT timestamp_agg, ticker, g, timestamp_agg = g AS is_prediction_period, CASE WHEN timestamp_agg < g THEN residual_return WHEN timestamp_agg = g THEN {at} ELSE {_NOISE} END AS residual_return, lag(residual_return) OVER ({ON}) AS residual_return_lag1 FROM ({rows})"


def _quadrupled(v: DataFrame) -> DataFrame:
    """Noise has eight digits, the last a five; four times it has six and rounds alike everywhere."""
    return v.withColumn("residual_return", 4 * F.col("residual_return"))


for _kind, _how in (("current", {"current_noise": True}), ("future", {"future": []})):
    add(f"gate_view_{_kind}", on(h, lambda p, how=_how: _quadrupled(_gate(p, **how))), _G, _GE, f"SELECT * REPLACE (4 * residual_return AS residual_return) FROM ({_gate_sql(_kind)})")
add("lcg_noise", on(d, lambda p: with_row_index(p).withColumn("noise", 4 * lcg_noise("row"))), "timestamp_agg:t ticker:s noise:d", D, f"SELECT *, ((((row_number() OVER (ORDER BY ticker, timestamp_agg) - 1) * 1103515245::BIGINT + 12345) % 2000000) / 1e6 - 1) AS noise FROM panel")
add("gate_coverage", on(h, lambda p: sig(p).where(F.col(TIME) >= CUT_H).where(is_finite("signal")).groupBy(TIME).agg(F.count(F.lit(1)).alias("found")).join(_hidden(p).groupBy(TIME).agg(F.countDistinct(NAME).alias("expected")), TIME).withColumn("enough", F.col("found") >= F.greatest(F.lit(1), F.floor(F.col("expected") * 0.01)))), "timestamp_agg:t found:l expected:l enough:b", HS, "SELECT timestamp_agg, count(*) AS found, count(DISTINCT ticker) AS expected, true AS enough FROM sig WHERE timestamp_agg >= '2024-01-22' GROUP BY 1")


#: Candidates: one that is causal, one that reads the label of its bar, one that reads a later bar.
CANDIDATES = {
    "lagged": (lambda v: v.withColumn("signal", -F.col("residual_return_lag1")), "-residual_return_lag1"),
    "same_bar": (lambda v: v.withColumn("signal", F.coalesce("residual_return", F.lit(0.0))), "coalesce(residual_return, 0)"),
    "ahead": (lambda v: v.withColumn("signal", F.coalesce(F.lead("residual_return").over(own()), F.lit(0.0))), f"coalesce(lead(residual_return) OVER ({ON}), 0)"),
}


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    p = h(spark, sf).persist()
    train, hid = p.where(F.col(TIME) < CUT_H), _hidden(p)
    rows = [(k, X.run_gate(f, train, hid)["status"]) for k, (f, _) in CANDIDATES.items()]
    p.unpersist()
    return spark.createDataFrame(rows, "candidate string, status string")


def _verdict_sql() -> str:
    parts = [f"SELECT '{k}' AS candidate, '{kind}' AS kind, ticker, signal FROM (SELECT ticker, is_prediction_period AS here, {e} AS signal FROM ({_gate_sql(kind)})) WHERE here AND isfinite(signal)" for k, (_, e) in CANDIDATES.items() for kind in ("base", "current", "future")]
    z = f"SELECT candidate, kind, ticker, least(greatest((signal - avg(signal) OVER o) / greatest(coalesce(stddev_samp(signal) OVER o, 1e-8), 1e-8), -4), 4) AS z FROM ({' UNION ALL '.join(parts)}) WINDOW o AS (PARTITION BY candidate, kind)"
    both = f"WITH z AS ({z}) SELECT candidate, kind, ticker, b.z AS base, o.z AS other FROM (SELECT candidate, ticker, z, unnest(['current', 'future']) AS kind FROM z WHERE kind = 'base') b FULL JOIN (SELECT * FROM z WHERE kind <> 'base') o USING (candidate, kind, ticker)"
    return f"SELECT candidate, CASE WHEN bool_or(base IS NULL OR other IS NULL OR abs(base - other) > 1e-8) THEN 'failed' ELSE 'passed' END AS status FROM ({both}) GROUP BY 1"


add("gate_verdict", _verdicts, "candidate:s status:s", _GE, _verdict_sql())
add("policy_scan", lambda s, sf: X.policy_scan(A.table(s, sf, "part").select("p_partkey", F.concat(F.lit("x = '"), "p_name", F.when(F.col("p_partkey") % 3 == 0, "/tests/a'").when(F.col("p_partkey") % 3 == 1, "test.parquet'").otherwise("'")).alias("code"))), "p_partkey:l violations:l", "v AS (SELECT 1)", "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN 1 ELSE 0 END AS violations FROM part")
add("cheat_flag", on(d, lambda p: M.cheat_flag(G.return_corr(G.scored(p.select(*KEYS, F.col("residual_return").alias("signal")), p)))), "return_correlation:d cheating_detected:b", DS, f"SELECT c AS return_correlation, abs(c) > .9 AS cheating_detected FROM (SELECT {corr('x', 'y')} AS c FROM (SELECT p.residual_return AS x, r.residual_return AS y FROM panel p JOIN panel r USING (timestamp_agg, ticker) WHERE p.residual_return IS NOT NULL))")

# scoring
_MET = "m AS (SELECT o_orderkey, (o_orderkey % 50) / 10.0 AS dk_tstat, (o_orderkey % 23) / 10.0 AS sharpe, (o_orderkey % 101) / 100.0 AS autocorrelation, ((o_orderkey % 41) - 20) / 1000.0 AS mean_ic, (o_orderkey % 19) / 19.0 AS return_correlation, (o_orderkey % 100) / 100.0 AS ic_positive FROM orders)"


def _metrics(s: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return A.table(s, sf, "orders").select("o_orderkey", (k % 50 / 10).alias("dk_tstat"), (k % 23 / 10).alias("sharpe"), (k % 101 / 100).alias("autocorrelation"), ((k % 41 - 20) / 1000).alias("mean_ic"), (k % 19 / 19).alias("return_correlation"), (k % 100 / 100).alias("ic_positive"))


_PEN = "CASE WHEN autocorrelation > .999 THEN .4 WHEN autocorrelation >= .5 THEN 0 WHEN autocorrelation < .1 THEN .4 ELSE (.5 - autocorrelation) / .4 * .4 END"
_COMB = f"greatest(.4 * CASE WHEN dk_tstat >= 4 THEN 1 WHEN dk_tstat >= 3 THEN .8 WHEN dk_tstat >= 2 THEN .6 WHEN dk_tstat >= 1 THEN .2 ELSE 0 END + .6 * CASE WHEN sharpe >= 2 THEN 1 WHEN sharpe >= 1.5 THEN .8 WHEN sharpe >= 1 THEN .4 WHEN sharpe >= .7 THEN .2 ELSE 0 END - {_PEN}, .05)::DOUBLE"
add("score_combined", lambda s, sf: M.combined(_metrics(s, sf)), "o_orderkey:l score:d", _MET, f"SELECT o_orderkey, {_COMB} AS score FROM m")
add("score_checker", lambda s, sf: M.checker(_metrics(s, sf)), "o_orderkey:l score:d", _MET, "SELECT o_orderkey, .45 * least(greatest(dk_tstat / 3, 0), 1) + .4 * least(greatest(sharpe, 0), 1) + .15 * CASE WHEN autocorrelation BETWEEN .5 AND .95 THEN 1 ELSE greatest(0, 1 - abs(autocorrelation - .725) / .5) END AS score FROM m")
add("score_local", lambda s, sf: M.local(_metrics(s, sf)), "o_orderkey:l score:d passed:b", _MET, "SELECT o_orderkey, CASE WHEN abs(return_correlation) > .9 THEN -1 ELSE least(greatest(100 * mean_ic, -1), 1.5) END AS score, abs(return_correlation) <= .9 AND mean_ic > .003 AS passed FROM m")
add("implausible_flags", lambda s, sf: M.implausible(_metrics(s, sf).withColumn("sharpe", F.col("sharpe") * 5).withColumn("mean_ic", F.col("mean_ic") * 4.1)), "o_orderkey:l sharpe_flag:b ic_flag:b positive_flag:b", _MET, "SELECT o_orderkey, abs(sharpe * 5) >= 7 AS sharpe_flag, abs(mean_ic * 4.1) >= .05 AS ic_flag, ic_positive >= .95 AS positive_flag FROM m")


def _gaps(p: DataFrame) -> DataFrame:
    late = F.col(TIME) >= CUT_D
    half = lambda f, c: [f(F.when(~late, F.col(c))), f(F.when(late, F.col(c)))]
    ic = [c.alias(k) for c, k in zip(half(F.avg, "ic"), ("is_ic", "oos_ic"), strict=True)]
    mean, std = half(F.avg, "net_ret"), half(F.stddev_samp, "net_ret")
    sharpe = [safe_div(m, s, 0.0).alias(k) for m, s, k in zip(mean, std, ("is_sharpe", "oos_sharpe"), strict=True)]
    both = G.ic_per_bar(sc(p)).agg(*ic).unionByName(bt(p).agg(*sharpe), allowMissingColumns=True)
    return M.gaps(both.agg(*(F.max(c).alias(c) for c in both.columns)))


add("is_oos_gap", on(d, _gaps), "is_ic:d oos_ic:d ic_gap_pct:d sharpe_gap_pct:d", _with(DB, SCORED, IC), "SELECT *, abs(is_ic - oos_ic) / abs(is_ic) * 100 AS ic_gap_pct, abs(i - o) / abs(i) * 100 AS sharpe_gap_pct FROM (SELECT avg(ic) FILTER (timestamp_agg < '2000-01-01') AS is_ic, avg(ic) FILTER (timestamp_agg >= '2000-01-01') AS oos_ic FROM ic), (SELECT avg(net_ret) FILTER (timestamp_agg < '2000-01-01') / stddev_samp(net_ret) FILTER (timestamp_agg < '2000-01-01') AS i, avg(net_ret) FILTER (timestamp_agg >= '2000-01-01') / stddev_samp(net_ret) FILTER (timestamp_agg >= '2000-01-01') AS o FROM bt)")

# splits
_UNITS = {"month": "year(timestamp_agg) * 12 + month(timestamp_agg)", "week": "year(timestamp_agg) * 53 + week(timestamp_agg)", "day": "year(timestamp_agg) * 366 + dayofyear(timestamp_agg)"}
add("stripe_ordinal", on(h, lambda p: p.select(TIME).distinct().select(TIME, *(stripe_ordinal(TIME, u).alias(u) for u in S.UNITS))), "timestamp_agg:t month:l week:l day:l hour:l", H, "SELECT DISTINCT timestamp_agg, " + ", ".join(f"{v} AS \"{k}\"" for k, v in _UNITS.items()) + f", ({_UNITS['day']}) * 24 + hour(timestamp_agg) AS \"hour\" FROM panel")
add("split_stripe", on(d, lambda p: p.select(*KEYS, S.masks(p, S.SplitSpec("s", "stripe", "t", details={"unit": "month", "modulus": 2, "holdout": 0}))[1].alias("is_test"))), "timestamp_agg:t ticker:s is_test:b", D, f"SELECT *, ({_UNITS['month']}) % 2 = 0 AS is_test FROM panel")
add("split_fixed", on(d, lambda p: reduce(lambda a, b: a.unionByName(b), (x.agg(F.lit(n).alias("side"), F.count(F.lit(1)).alias("n"), F.min(TIME).alias("first"), F.max(TIME).alias("last")) for n, x in (("train", p.where(F.col(TIME) < CUT_D)), ("test", p.where(F.col(TIME) >= CUT_D)))))), "side:s n:l first:t last:t", D, "SELECT CASE WHEN timestamp_agg < '2000-01-01' THEN 'train' ELSE 'test' END AS side, count(*) AS n, min(timestamp_agg) AS first, max(timestamp_agg) AS last FROM panel GROUP BY 1")


def _sides(p: DataFrame, spec: S.SplitSpec) -> DataFrame:
    train, test = S.masks(p, spec)
    return p.select(*KEYS, F.when(train, "train").when(test, "test").otherwise("none").alias("side"))


def _rolling(p: DataFrame) -> DataFrame:
    t, u = S.rolling(*S.time_range(p))[0]
    return _sides(p, S.SplitSpec("r", "rolling", "t", 0, 24, t, (u,)))


add("split_rolling", on(d, _rolling), "timestamp_agg:t ticker:s side:s", _with(D, "z AS (SELECT date_trunc('month', min(timestamp_agg)) AS a, max(timestamp_agg) AS last FROM panel)"), "SELECT timestamp_agg, ticker, CASE WHEN timestamp_agg < a + INTERVAL 36 MONTH AND timestamp_agg < a + INTERVAL 36 MONTH - INTERVAL 24 HOUR THEN 'train' WHEN timestamp_agg >= a + INTERVAL 36 MONTH AND timestamp_agg < a + INTERVAL 48 MONTH THEN 'test' ELSE 'none' END AS side FROM panel, z")
_BLOCKS = ((datetime(1996, 3, 1), datetime(1996, 5, 1) - S.TICK), (datetime(1998, 7, 1), datetime(1998, 9, 1) - S.TICK))
_BLOCK_SQL = "(timestamp_agg >= '1996-03-01' AND timestamp_agg < '1996-05-01') OR (timestamp_agg >= '1998-07-01' AND timestamp_agg < '1998-09-01')"
_NEAR_SQL = "(timestamp_agg >= TIMESTAMP '1996-02-29' AND timestamp_agg < TIMESTAMP '1996-05-02') OR (timestamp_agg >= TIMESTAMP '1998-06-30' AND timestamp_agg < TIMESTAMP '1998-09-02')"
add("split_random_block", on(d, lambda p: _sides(p, S.SplitSpec("b", "random_block", "t", 0, 24, None, _BLOCKS))), "timestamp_agg:t ticker:s side:s", D, f"SELECT *, CASE WHEN {_BLOCK_SQL} THEN 'test' WHEN {_NEAR_SQL} THEN 'none' ELSE 'train' END AS side FROM panel")
add("purge_train", on(d, lambda p: p.where(S.purge(F.col(TIME), _BLOCKS, 24)).select(*KEYS)), "timestamp_agg:t ticker:s", D, f"SELECT * FROM panel WHERE NOT ({_NEAR_SQL})")
add("split_slice", on(d, lambda p: S.cut_split(p, S.SplitSpec("b", "random_block", "t", 0, 24, None, _BLOCKS))[1].select(*KEYS)), "timestamp_agg:t ticker:s", D, f"SELECT * FROM panel WHERE {_BLOCK_SQL}")
add("split_validation", on(d, lambda p: S.validation(p.where(F.col(TIME) < CUT_D), S.ValidationConfig("is-month-stripe")).select(*KEYS, "is_validation")), "timestamp_agg:t ticker:s is_validation:b", D, f"SELECT *, (dense_rank() OVER (ORDER BY {_UNITS['month']}) - 1) % 2 = 1 AS is_validation FROM panel WHERE timestamp_agg < '2000-01-01'")
add("month_calendar", on(d, S.month_calendar), "month:a", D, "SELECT unnest(generate_series((SELECT date_trunc('month', min(timestamp_agg)) FROM panel)::TIMESTAMP, (SELECT max(timestamp_agg) FROM panel)::TIMESTAMP, INTERVAL 1 MONTH)) AS month")


def _plan(s: SparkSession, sf: str) -> DataFrame:
    p = d(s, sf)
    specs = S.plan("t", p.where(F.col(TIME) < CUT_D), p.where(F.col(TIME) >= CUT_D), S.SplitConfig())
    until = lambda r: (r[0], r[1] + S.TICK) if r else (None, None)
    ends = lambda x: (*until(x.train), *until(x.tests[0] if x.family == "rolling" else None))
    rows = [(k, x.name, x.family, x.purge_hours, *ends(x)) for k, x in enumerate(specs)]
    return s.createDataFrame(rows, "place int, name string, family string, purge_hours int, train_start timestamp, train_until timestamp, test_start timestamp, test_until timestamp")


# rolling train and test ranges and stripes; drawn blocks come from Python's generator, so their rows only name the family
_PLANNED = D + """,
r AS (SELECT min(timestamp_agg) AS low, max(timestamp_agg) AS high, date_trunc('month', min(timestamp_agg))::TIMESTAMP AS first FROM panel),
ro AS (SELECT k, first + to_months(12 * k::INT) AS a, first + to_months(36 + 12 * k::INT) AS t, high FROM r, (SELECT unnest(generate_series(0, 1)) AS k) WHERE first + to_months(36 + 12 * k::INT) <= high),
st AS (SELECT unnest([0, 1]) AS h),
own AS (SELECT 3 * k AS place, 'rolling-00' || (k + 1) AS name, 'rolling' AS family, a AS train_start, t AS train_until, t AS test_start, least(t + to_months(12), high + INTERVAL 1 MICROSECOND) AS test_until FROM ro
  UNION ALL SELECT 3 * k + 1, 'random-block-00' || (k + 1), 'random_block', NULL, NULL, NULL, NULL FROM ro
  UNION ALL SELECT 3 * h + 2, 'stripe-month-mod2-h' || h, 'stripe', NULL, NULL, NULL, NULL FROM st)"""
add("split_plan", _plan, "place:l name:s family:s purge_hours:l train_start:t train_until:t test_start:t test_until:t", _PLANNED, "SELECT *, 24 AS purge_hours FROM own")
add("bundle_checksums", lambda s, sf: A.checksums(s, sf).select("name", "size", "sha256"), "name:s size:l sha256:s")


# many streams
def streams(p: DataFrame) -> DataFrame:
    lags = p.select(*KEYS, "residual_return", "return", *(F.lag("residual_return", k).over(own()).alias(f"l{k}") for k in (1, 2, 3)))
    one = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(k).alias("attempt"), (-F.col(f"l{k}") * F.col(c) * 1e4).alias("x")) for m, c in (("A", "residual_return"), ("B", "return")) for k in (1, 2, 3))))
    task = F.concat(F.lit("T"), (F.substring(NAME, -1, 1).cast("int") % 4).cast("string"))
    rows = lags.select(task.alias("task"), F.to_date(TIME).alias("date"), one.alias("s")).select("task", "date", "s.*").where("x is not null")
    return rows.groupBy("task", "model", "attempt", "date").agg(F.avg("x").alias("daily_ret"))


add("pnl_unit_vol", on(d, lambda p: P.unit_vol(streams(p))), "task:s model:s attempt:l date:a unit_ret:d", DP, "SELECT * FROM unit")
_CURVE = "curve AS (SELECT *, sum(ret) OVER (PARTITION BY model, attempt ORDER BY date ROWS UNBOUNDED PRECEDING) AS pnl FROM (SELECT model, attempt, date, avg(unit_ret) AS ret FROM unit GROUP BY 1, 2, 3))"
add("portfolio_curve", on(d, lambda p: P.portfolio_curve(streams(p))), "model:s attempt:l date:a ret:d pnl:d", _with(DP, _CURVE), "SELECT * FROM curve")
add("portfolio_sharpe", on(d, lambda p: P.portfolio_sharpe(streams(p))), "model:s attempt:l sharpe:d", _with(DP, _CURVE), "SELECT model, attempt, avg(ret) * sqrt(365) / stddev_samp(ret) AS sharpe FROM curve GROUP BY 1, 2")
add("pooled_sharpe", on(d, lambda p: P.pooled_sharpe(streams(p))), "model:s attempt:l sharpe:d", DP, "SELECT model, attempt, avg(unit_ret) * sqrt(365) / stddev_samp(unit_ret) AS sharpe FROM unit GROUP BY 1, 2")
_TC = f"per AS (SELECT task, date, avg(unit_ret) AS r FROM unit GROUP BY 1, 2), tc AS (SELECT a.task AS task_a, b.task AS task_b, {corr('a.r', 'b.r')} AS corr, count(*) AS n FROM per a JOIN per b USING (date) WHERE a.task < b.task GROUP BY 1, 2)"
add("task_corr", on(d, lambda p: P.task_corr(streams(p))), "task_a:s task_b:s corr:d n:l", _with(DP, _TC), "SELECT * FROM tc")
add("offdiag_corr", on(d, lambda p: P.offdiag_corr(streams(p))), "offdiag_corr:d pairs:l", _with(DP, _TC), "SELECT avg(corr) AS offdiag_corr, count(*) AS pairs FROM tc")
add("mean_reversion_factor", on(d, lambda p: P.factor_corr(streams(p), B.daily_pnl(bt(p)))), "task:s factor_corr:d n:l", _with(DB, STREAMS, _TC), f"SELECT task, {corr('r', 'daily_ret')} AS factor_corr, count(*) AS n FROM per JOIN daily USING (date) GROUP BY 1")
add("attempt_corr", on(d, lambda p: P.attempt_corr(streams(p))), "task:s model:s attempt:l corr:d n:l", DP, f"SELECT a.task, a.model, a.attempt, {corr('a.daily_ret', 'b.daily_ret')} AS corr, count(*) AS n FROM streams a JOIN streams b ON a.task = b.task AND a.model = b.model AND b.attempt = a.attempt + 1 AND a.date = b.date GROUP BY 1, 2, 3")


def _pairs(p: DataFrame) -> DataFrame:
    x = P.unit_vol(streams(p)).withColumn("oos", F.col("date") >= F.lit("2000-01-01").cast("date"))
    return x.groupBy(*P.STREAM).agg(*((F.avg(F.when(k, F.col("unit_ret"))) * 365**0.5 / F.stddev_samp(F.when(k, F.col("unit_ret")))).alias(n) for n, k in (("is_sharpe", ~F.col("oos")), ("oos_sharpe", F.col("oos")))))


add("sharpe_scatter", on(d, lambda p: P.sharpe_scatter(_pairs(p))), "r:d n:l t:d", DP, "SELECT r, n, r * sqrt(n - 2) / sqrt(1 - r * r) AS t FROM (SELECT corr(least(greatest(a, -5), 5), least(greatest(b, -5), 5)) AS r, count(*) AS n FROM (SELECT avg(unit_ret) FILTER (date < '2000-01-01') * sqrt(365) / stddev_samp(unit_ret) FILTER (date < '2000-01-01') AS a, avg(unit_ret) FILTER (date >= '2000-01-01') * sqrt(365) / stddev_samp(unit_ret) FILTER (date >= '2000-01-01') AS b FROM unit GROUP BY task, model, attempt))")


def _gates(x: DataFrame) -> DataFrame:
    """A stream passes where its mean daily return is not negative."""
    return x.groupBy(*P.STREAM).agg(F.when(F.avg("daily_ret") < 0, "failed").otherwise("passed").alias("status"))


add("gate_exclusion", on(d, lambda p: (lambda x: P.gate_exclusion(x, _gates(x)))(streams(p))), "task:s model:s attempt:l date:a daily_ret:d", _with(
    DP, "gates AS (SELECT task, model, attempt, CASE WHEN avg(daily_ret) < 0 THEN 'failed' ELSE 'passed' END AS status FROM streams GROUP BY 1, 2, 3)",
    "latest AS (SELECT task, model, arg_max(status, attempt) AS status FROM gates GROUP BY 1, 2)"), "SELECT * FROM streams ANTI JOIN (SELECT * FROM latest WHERE status = 'failed') f USING (task, model)")

# residuals and transforms
_TICK = lambda n, upto=0: f"({ON} ROWS BETWEEN {n} PRECEDING AND {'CURRENT ROW' if not upto else f'{upto} PRECEDING'})"
_K = "timestamp_agg:t ticker:s "


def tf(name: str, source: Callable, column: Callable, expr: str, ctes: str) -> None:
    """One-column transform: a column or a frame that has it, and its SQL."""

    def frame(spark, sf):
        p = source(spark, sf)
        x = column(p)
        return x if isinstance(x, DataFrame) else p.withColumn(name, x)

    add(name, frame, _K + f"{name}:d", ctes, f"SELECT timestamp_agg, ticker, {expr} AS {name} FROM panel")


def _slope_sql(y: str, x: str, over: str, least: str = "1e-18") -> str:
    a, b = f"CASE WHEN {x} IS NOT NULL THEN {y} END", f"CASE WHEN {y} IS NOT NULL THEN {x} END"
    return f"covar_pop({a}, {b}) OVER {over} / CASE WHEN var_pop({b}) OVER {over} > {least} THEN var_pop({b}) OVER {over} END"


tf("market_return", d, lambda p: T.market_return(["S1", "S2"]), "avg(CASE WHEN ticker IN ('S1', 'S2') THEN \"return\" END) OVER (PARTITION BY timestamp_agg)", D)
_MKT = D.replace("panel AS (", "p0 AS (") + ",\npanel AS (SELECT *, avg(\"return\") OVER (PARTITION BY timestamp_agg) AS mkt FROM p0)"
tf("rolling_beta", d, lambda p: p.withColumn("mkt", F.avg("return").over(bar())).withColumn("rolling_beta", T.rolling_beta("return", "mkt", 20)), _slope_sql('"return"', "mkt", _TICK(20, 1)), _MKT)
_RB = "(PARTITION BY timestamp_agg)"
tf("residualize", d, lambda p: T.residualize("return", "volume"), f'CASE WHEN "return" IS NOT NULL THEN "return" - avg("return") OVER {_RB} - coalesce({_slope_sql(chr(34) + "return" + chr(34), "volume", _RB)}, 0) * (volume - avg(CASE WHEN "return" IS NOT NULL THEN volume END) OVER {_RB}) END', D)
tf("relative_volume", d, lambda p: T.relative_volume("volume", 20), f"volume / avg(volume) OVER {_TICK(20, 1)}", D)
tf("log_shock", h, lambda p: T.log_shock("volume", 24), f"CASE WHEN volume > 0 THEN ln(volume / nullif(quantile_cont(volume, 0.5) OVER {_TICK(24, 1)}, 0)) END", H)
tf("ts_zscore", d, lambda p: T.ts_zscore("volume", 20), f"(volume - avg(volume) OVER {_TICK(19)}) / nullif(stddev_samp(volume) OVER {_TICK(19)}, 0)", D)
tf("ts_rank", h, lambda p: T.ts_rank("volume", 24), f"len(list_filter(list(volume) OVER {_TICK(23)}, lambda v: v <= volume)) / len(list(volume) OVER {_TICK(23)})::DOUBLE", H)
tf("ewm_mean", h, lambda p: T.ewm_mean("volume", 0.2, 12), "(" + " + ".join(f"coalesce(lag(volume, {k}) OVER ({ON}), 0) * {0.8**k!r}" for k in range(12)) + ") / (" + " + ".join(f"CASE WHEN lag(volume, {k}) OVER ({ON}) IS NULL THEN 0 ELSE {0.8**k!r} END" for k in range(12)) + ")", H)
tf("realized_vol", d, lambda p: T.realized_vol("return", 20), f'stddev_samp("return") OVER {_TICK(19)}', D)
tf("downside_vol", d, lambda p: T.downside_vol("return", 20), f'stddev_samp(CASE WHEN "return" < 0 THEN "return" END) OVER {_TICK(19)}', D)
tf("vol_of_vol", h, lambda p: T.vol_of_vol(p, "return", 24), f"stddev_samp(vol) OVER {_TICK(23)}", H.replace("panel AS (", "p0 AS (") + f',\npanel AS (SELECT *, stddev_samp("return") OVER {_TICK(23)} AS vol FROM p0)')
tf("max_return", d, lambda p: T.max_return("return", 20), f'max("return") OVER {_TICK(19)}', D)
tf("topk_mean_return", h, lambda p: T.topk_mean("return", 24, 3), "list_avg(list_slice(list_reverse_sort(list_filter(r, lambda v: v IS NOT NULL)), 1, 3))", H.replace("panel AS (", "p0 AS (") + f',\npanel AS (SELECT *, list("return") OVER {_TICK(23)} AS r FROM p0)')
tf("bollinger_z", d, lambda p: T.bollinger("close", 20), f"(close - avg(close) OVER {_TICK(19)}) / nullif(stddev_samp(close) OVER {_TICK(19)}, 0) / 2", D)
_STEP = lambda c, e: D.replace("panel AS (", "p0 AS (") + f",\npanel AS (SELECT *, {e} AS {c} FROM p0)"
tf("rsi", d, lambda p: T.rsi(p, "close", 14), f"CASE WHEN step IS NOT NULL THEN coalesce(100 * avg(CASE WHEN step IS NOT NULL THEN greatest(step, 0) ELSE 0 END) OVER {_TICK(13)} / nullif(avg(CASE WHEN step IS NOT NULL THEN greatest(step, 0) ELSE 0 END) OVER {_TICK(13)} + avg(CASE WHEN step IS NOT NULL THEN greatest(-step, 0) ELSE 0 END) OVER {_TICK(13)}, 0), 50) END", _STEP("step", f"close - lag(close) OVER ({ON})"))
tf("ar1_speed", d, lambda p: T.ar1_speed(p, "return", 20), f"1 - {_slope_sql(chr(34) + 'return' + chr(34), 'before', _TICK(19))}", _STEP("before", f'lag("return") OVER ({ON})'))
_RC = ('CASE WHEN volume IS NOT NULL THEN "return" END', 'CASE WHEN "return" IS NOT NULL THEN volume END', _TICK(19))
tf("rolling_corr", d, lambda p: T.rolling_corr("return", "volume", 20), "covar_pop({0}, {1}) OVER {2} / CASE WHEN stddev_pop({0}) OVER {2} * stddev_pop({1}) OVER {2} > 1e-18 THEN stddev_pop({0}) OVER {2} * stddev_pop({1}) OVER {2} END".format(*_RC), D)
add("volume_clock", on(d, T.volume_clock), _K + "clock:d acceleration:d", D, f"SELECT *, sum(volume) OVER ({ON} ROWS UNBOUNDED PRECEDING) AS clock, volume - lag(volume) OVER ({ON}) AS acceleration FROM panel")
tf("hour_baseline", h, lambda p: safe_div("volume", T.slot_mean("volume", F.hour(TIME))), "volume / avg(volume) OVER (PARTITION BY ticker, hour(timestamp_agg) ORDER BY timestamp_agg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", H)
tf("seasonal_mean", d, lambda p: T.slot_mean("return", F.dayofweek(TIME)), 'avg("return") OVER (PARTITION BY ticker, dayofweek(timestamp_agg) ORDER BY timestamp_agg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)', D)
tf("vwap_dev", d, lambda p: T.vwap_dev(20), f"close / (sum(close * volume) OVER {_TICK(19)} / sum(volume) OVER {_TICK(19)}) - 1", D)
_REG = D.replace("panel AS (", "p0 AS (") + f',\np1 AS (SELECT *, stddev_samp("return") OVER {_TICK(19)} AS vol, lag(residual_return) OVER ({ON}) AS l1, lag(residual_return, 2) OVER ({ON}) AS l2 FROM p0),\nbv AS (SELECT timestamp_agg, avg(vol) AS v FROM p1 GROUP BY 1),\nhv AS (SELECT timestamp_agg, v > avg(v) OVER (ORDER BY timestamp_agg ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS high FROM bv),\npanel AS (SELECT p1.*, high FROM p1 JOIN hv USING (timestamp_agg))'
tf("regime_blend", d, lambda p: T.regime_blend(X.with_lags(p, ["residual_return"], (1, 2)), "residual_return_lag1", "residual_return_lag2").withColumnRenamed("blend", "regime_blend"), "CASE WHEN high THEN l2 ELSE l1 END", _REG)
tf("cs_rank", d, lambda p: T.cs_rank("volume"), f"CASE WHEN count(volume) OVER (PARTITION BY timestamp_agg) > 1 THEN (({average_rank('volume', 'timestamp_agg')}) - 1) / (count(volume) OVER (PARTITION BY timestamp_agg) - 1) ELSE 0.5 END", D)
tf("winsorize", d, lambda p: T.winsorize("residual_return"), "CASE WHEN residual_return IS NOT NULL THEN least(greatest(residual_return, quantile_cont(residual_return, 0.05) OVER (PARTITION BY timestamp_agg)), quantile_cont(residual_return, 0.95) OVER (PARTITION BY timestamp_agg)) END", D)
tf("imbalance", d, lambda p: T.imbalance("volume", "n_obs"), "(volume - n_obs) / nullif(volume + n_obs, 0)", D)
_PRE = D.replace("panel AS (", "p0 AS (") + f",\np1 AS (SELECT *, least(greatest((close - m) * 100 / m, -10), 10) AS raw FROM (SELECT *, avg(close) OVER (PARTITION BY timestamp_agg) AS m FROM p0)),\np2 AS (SELECT *, lag(raw) OVER ({ON}) AS premium FROM p1),\npanel AS (SELECT *, premium - lag(premium) OVER ({ON}) AS change FROM p2)"
add("premium_features", on(d, lambda p: T.premium(p.withColumn("m", F.avg("close").over(bar())), "close", "m")), _K + "premium:d change:d acceleration:d", _PRE, f"SELECT *, change - lag(change) OVER ({ON}) AS acceleration FROM panel")
_WF = D.replace("panel AS (", "p0 AS (") + f""",
p1 AS (SELECT *, year(timestamp_agg) AS block, lag(residual_return) OVER ({ON}) AS x FROM p0),
bm AS (SELECT block, count(*) FILTER (ok) AS n, sum(x) FILTER (ok) AS sx, sum(y) FILTER (ok) AS sy, sum(x * x) FILTER (ok) AS sxx, sum(x * y) FILTER (ok) AS sxy
       FROM (SELECT block, x, residual_return AS y, x IS NOT NULL AND residual_return IS NOT NULL AS ok FROM p1) GROUP BY 1),
rm AS (SELECT block, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxx) OVER w AS sxx, sum(sxy) OVER w AS sxy
       FROM bm WINDOW w AS (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fit AS (SELECT block, n, sx, sy, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS slope FROM rm),
panel AS (SELECT p1.*, (sy - slope * sx) / n + slope * x AS walk_forward_ols FROM p1 JOIN fit USING (block))"""
add("walk_forward_ols", on(d, lambda p: T.walk_forward(p.withColumn("x", F.lag("residual_return").over(own())), "residual_return", "x", F.year(TIME)).withColumnRenamed("predicted", "walk_forward_ols")), _K + "walk_forward_ols:d", _WF, "SELECT * FROM panel")
add("walk_forward_ridge", on(d, lambda p: T.walk_forward(p.withColumn("x", F.lag("residual_return").over(own())), "residual_return", "x", F.year(TIME), 0.01).withColumnRenamed("predicted", "walk_forward_ridge")), _K + "walk_forward_ridge:d",
    _WF.replace("n * sxx - sx * sx", "n * sxx - sx * sx + n * 0.01::DOUBLE").replace("walk_forward_ols", "walk_forward_ridge"), "SELECT * FROM panel")
_EW = H.replace("panel AS (", "p0 AS (") + ",\np1 AS (SELECT *, " + ", ".join(f"lag(volume, {k}) OVER ({ON}) AS v{k}" for k in range(12)) + " FROM p0),\np2 AS (SELECT *, " + " + ".join(f"CASE WHEN v{k} IS NULL THEN 0 ELSE {0.8**k!r}::DOUBLE END" for k in range(12)) + " AS wt FROM p1),\npanel AS (SELECT *, (" + " + ".join(f"coalesce(v{k}, 0) * {0.8**k!r}::DOUBLE" for k in range(12)) + ") / wt AS m FROM p2)"
tf("ewm_std", h, lambda p: T.ewm_std("volume", 0.2, 12), "sqrt((" + " + ".join(f"coalesce((v{k} - m) * (v{k} - m), 0) * {0.8**k!r}::DOUBLE" for k in range(12)) + ") / wt)", _EW)
_LAST = lambda src, e, n: src.replace("panel AS (", "p0 AS (") + f",\npanel AS (SELECT *, list({e}) OVER {_TICK(n - 1)} AS r FROM p0)"
tf("mad", d, lambda p: T.mad("volume", 20), "list_median(list_transform(r, lambda v: abs(v - list_median(r))))", _LAST(D, "volume", 20))
tf("trailing_p99", d, lambda p: T.trailing_quantile("volume", 20, 0.99), f"quantile_cont(volume, 0.99) OVER {_TICK(19)}", D)
tf("market_relative_vol", d, lambda p: T.market_relative_vol(p, "return", 20), "vol / nullif(avg(vol) OVER (PARTITION BY timestamp_agg), 0)", _STEP("vol", f'stddev_samp("return") OVER {_TICK(19)}'))
_CC = _STEP("corr", "covar_pop({0}, {1}) OVER {2} / CASE WHEN stddev_pop({0}) OVER {2} * stddev_pop({1}) OVER {2} > 1e-18 THEN stddev_pop({0}) OVER {2} * stddev_pop({1}) OVER {2} END".format(*_RC))
add("corr_change", on(d, lambda p: T.corr_change(p, "return", "volume", 20)), _K + "change:d stability:d", _CC, f"SELECT timestamp_agg, ticker, corr - lag(corr, 20) OVER ({ON}) AS change, stddev_samp(corr) OVER {_TICK(19)} AS stability FROM panel")
_SIGN = lambda k: f"list_transform(r, lambda a: list_sum(list_transform(r, lambda b: sign(a.{k} - b.{k}))))"
_RANKED = D.replace("panel AS (", "p0 AS (") + f""",
p1 AS (SELECT *, list_filter(list(CASE WHEN "return" IS NOT NULL THEN {{'x': "return", 'y': volume}} END) OVER {_TICK(9)}, lambda v: v IS NOT NULL) AS r FROM p0),
panel AS (SELECT *, {_SIGN('x')} AS a, {_SIGN('y')} AS b FROM p1)"""
tf("rolling_rank_corr", d, lambda p: T.rolling_rank_corr("return", "volume", 10), "list_dot_product(a::DOUBLE[], b::DOUBLE[]) / nullif(sqrt(list_dot_product(a::DOUBLE[], a::DOUBLE[]) * list_dot_product(b::DOUBLE[], b::DOUBLE[])), 0)", _RANKED)
tf("amihud", d, lambda p: T.amihud(20), f'1e6 * avg(abs("return") / nullif(close * volume, 0)) OVER {_TICK(19)}', D)
tf("flow_ratio", d, lambda p: T.flow_ratio("n_obs", "volume", 20), f"sum(n_obs) OVER {_TICK(19)} / nullif(sum(volume) OVER {_TICK(19)}, 0)::DOUBLE", D)
add("cluster_spread", on(d, lambda p: T.cluster_spread(p, "return")), _K + "cluster:l spread:d")


def _asof(spark: SparkSession, sf: str) -> DataFrame:
    p = h(spark, sf)
    day = p.groupBy(F.date_trunc("day", TIME).alias(TIME), NAME).agg(F.sum("volume").alias("day_volume"))
    return T.asof_daily(p.select(*KEYS, "close"), day, ["day_volume"])


add("asof_daily_to_hourly", _asof, _K + "close:d day_volume:d", H + ",\ndv AS (SELECT date_trunc('day', timestamp_agg) + INTERVAL 1 DAY AS t, ticker, sum(volume) AS day_volume FROM panel GROUP BY 1, 2)", "SELECT p.timestamp_agg, p.ticker, p.close, d.day_volume FROM panel p ASOF LEFT JOIN dv d ON p.ticker = d.ticker AND p.timestamp_agg >= d.t")


def _stream_scores(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias(TIME), F.col("event_type").alias(NAME), "value")
    return bar_scores(events, "value")


add("stream_bar_scores", _stream_scores, _K + "value:d score:d",
    "e AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS timestamp_agg, event_type AS ticker, avg(value) AS value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2)",
    "SELECT *, least(greatest((value - avg(value) OVER b) / greatest(coalesce(stddev_samp(value) OVER b, 0), 1e-8), -4), 4) AS score FROM e WINDOW b AS (PARTITION BY timestamp_agg)")


# regressions on several columns, exact recursions
def _two_sql(v: str) -> str:
    """Coefficients b1, b2 of y on x and z from co-moments; a column without variation of its own gets 0."""
    rest = f"({v}.vzz - CASE WHEN {v}.vxx > 1e-18 THEN {v}.vxz * {v}.vxz / {v}.vxx ELSE 0 END)"
    top = f"({v}.czy - CASE WHEN {v}.vxx > 1e-18 THEN {v}.vxz * {v}.cxy / {v}.vxx ELSE 0 END)"
    b2 = f"CASE WHEN {rest} > 1e-18 AND {rest} > 1e-9 * {v}.vzz THEN {top} / {rest} ELSE 0 END"
    return f"CASE WHEN {v}.vxx > 1e-18 THEN ({v}.cxy - {v}.vxz * ({b2})) / {v}.vxx ELSE 0 END AS b1, {b2} AS b2"


_MOMENTS2 = "count(*) AS n, avg(y) AS my, avg(x) AS mx, avg(z) AS mz, var_pop(x) * count(*) AS vxx, var_pop(z) * count(*) AS vzz, covar_pop(x, z) * count(*) AS vxz, covar_pop(x, y) * count(*) AS cxy, covar_pop(z, y) * count(*) AS czy"
_RES2 = D.replace("panel AS (", "p0 AS (") + f""",
p1 AS (SELECT *, "return" AS y, volume AS x, ln(close) AS z FROM p0),
mo AS (SELECT timestamp_agg, {_MOMENTS2} FROM p1 WHERE y IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL GROUP BY 1),
fit AS (SELECT *, {_two_sql('mo')} FROM mo),
panel AS (SELECT p1.timestamp_agg, ticker, y - my - b1 * (x - mx) - b2 * (z - mz) AS residualize_two FROM p1 LEFT JOIN fit USING (timestamp_agg))"""
add("residualize_two", on(d, lambda p: L.residualize(p.withColumn("z", F.log("close")), "return", ["volume", "z"], name="residualize_two")), _K + "residualize_two:d", _RES2, "SELECT * FROM panel")
_WF2 = D.replace("panel AS (", "p0 AS (") + f""",
p1 AS (SELECT *, residual_return AS y, lag(residual_return) OVER ({ON}) AS x, lag(volume) OVER ({ON}) AS z, year(timestamp_agg) AS block FROM p0),
mo AS (SELECT b.block, {_MOMENTS2} FROM (SELECT DISTINCT block FROM p1) b JOIN p1 ON p1.block < b.block WHERE y IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL GROUP BY 1),
fit AS (SELECT *, {_two_sql('mo')} FROM mo),
panel AS (SELECT p1.timestamp_agg, ticker, my + b1 * (x - mx) + b2 * (z - mz) AS walk_forward_two FROM p1 LEFT JOIN fit USING (block))"""
add("walk_forward_two", on(d, lambda p: L.walk_forward(p.withColumn("x", F.lag("residual_return").over(own())).withColumn("z", F.lag("volume").over(own())), "residual_return", ["x", "z"], F.year(TIME), name="walk_forward_two")), _K + "walk_forward_two:d", _WF2, "SELECT * FROM panel")
_AGED = H.replace("panel AS (", "p0 AS (") + f""",
p1 AS (SELECT *, volume - first_value(volume) OVER ({ON}) AS x, row_number() OVER ({ON}) AS k FROM p0),
p2 AS (SELECT *, sum(pow(0.94, -k)) OVER w AS sw, sum(pow(0.94, -2 * k)) OVER w AS s2, sum(x * pow(0.94, -k)) OVER w AS sx, sum(x * x * pow(0.94, -k)) OVER w AS sxx FROM p1 WINDOW w AS ({ON} ROWS UNBOUNDED PRECEDING)),
panel AS (SELECT *, sx / sw AS m, greatest(sxx / sw - (sx / sw) * (sx / sw), 0) AS v, sw * sw - s2 AS rest FROM p2)"""
add("ewm_exact", on(h, lambda p: E.ewm(p, "volume", 0.06, seconds=2 * E.DAY)), _K + "ewm_mean:d ewm_std:d", _AGED,
    f"SELECT timestamp_agg, ticker, m + first_value(volume) OVER ({ON}) AS ewm_mean, CASE WHEN rest > 1e-15 * sw * sw THEN sqrt(v * sw * sw / rest) END AS ewm_std FROM panel")


def _ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Daily high, low and close of suppliers' prices; rows lie by supplier, as the windows along it need them."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = A.table(spark, sf, "lineitem").select(F.date_trunc("day", F.col("l_shipdate").cast("timestamp")).alias(TIME), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias(NAME), "l_extendedprice", "l_quantity")
    return rows.repartition(F.col(NAME)).groupBy(*KEYS).agg(F.max(price).cast("double").alias("high"), F.min(price).cast("double").alias("low"), (F.sum("l_extendedprice") / F.sum("l_quantity")).cast("double").alias("close"))


_ADX = f"""base AS (SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS timestamp_agg, 'S' || l_suppkey::VARCHAR AS ticker, max(l_extendedprice / l_quantity)::DOUBLE AS high,
    min(l_extendedprice / l_quantity)::DOUBLE AS low, (sum(l_extendedprice) / sum(l_quantity))::DOUBLE AS close FROM lineitem GROUP BY 1, 2),
mv AS (SELECT *, high - lag(high) OVER o AS up, lag(low) OVER o - low AS down, lag(close) OVER o AS c0, row_number() OVER o AS k FROM base WINDOW o AS ({ON})),
st AS (SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS m, greatest(high - low, abs(high - c0), abs(low - c0)) AS r FROM mv WHERE k > 1),
sm(ticker, k, p, m, r, adx) AS (
  SELECT ticker, k, p::DOUBLE, m::DOUBLE, r::DOUBLE, CASE WHEN r <> 0 THEN coalesce(100 * abs(p - m) / nullif(p + m, 0), 0) END FROM st WHERE k = 2
  UNION ALL
  SELECT ticker, k, p, m, r, CASE WHEN dx IS NULL THEN adx WHEN adx IS NULL THEN dx ELSE adx + (dx - adx) / 14 END FROM (
    SELECT *, CASE WHEN r <> 0 THEN coalesce(100 * abs(p - m) / nullif(p + m, 0), 0) END AS dx FROM (
      SELECT st.ticker, st.k, sm.p + (st.p - sm.p) / 14 AS p, sm.m + (st.m - sm.m) / 14 AS m, sm.r + (st.r - sm.r) / 14 AS r, sm.adx FROM sm JOIN st ON st.ticker = sm.ticker AND st.k = sm.k + 1))),
panel AS (SELECT b.timestamp_agg, b.ticker, 100 * p / nullif(r, 0) AS plus_di, 100 * m / nullif(r, 0) AS minus_di, CASE WHEN r <> 0 THEN adx END AS adx FROM mv b LEFT JOIN sm USING (ticker, k))"""
add("adx_regime", lambda spark, sf: E.hysteresis(E.adx(_ranges(spark, sf), "high", "low", "close", 14), "adx", 25.0, 18.0), _K + "plus_di:d minus_di:d adx:d regime:l",
    _ADX.replace("base AS", "RECURSIVE base AS", 1), f"SELECT *, coalesce(last_value(CASE WHEN adx >= 25 THEN 1 WHEN adx <= 18 THEN 0 END IGNORE NULLS) OVER ({ON} ROWS UNBOUNDED PRECEDING), 0) AS regime FROM panel")
_AC = _STEP("before", f'lag("return") OVER ({ON})').replace("panel AS (SELECT *", "p1 AS (SELECT *") + f""",
panel AS (SELECT timestamp_agg, ticker, covar_pop(a, b) OVER w / CASE WHEN stddev_pop(a) OVER w * stddev_pop(b) OVER w > 1e-18 THEN stddev_pop(a) OVER w * stddev_pop(b) OVER w END AS autocorr
  FROM (SELECT *, CASE WHEN before IS NOT NULL THEN "return" END AS a, CASE WHEN "return" IS NOT NULL THEN before END AS b FROM p1) WINDOW w AS ({ON} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
add("autocorr_regime", on(d, lambda p: E.hysteresis(p.withColumn("before", F.lag("return").over(own())).withColumn("autocorr", T.rolling_corr("return", "before", 20)), "autocorr", 0.2, -0.2)), _K + "autocorr:d regime:l", _AC,
    f"SELECT *, coalesce(last_value(CASE WHEN autocorr >= 0.2 THEN 1 WHEN autocorr <= -0.2 THEN 0 END IGNORE NULLS) OVER ({ON} ROWS UNBOUNDED PRECEDING), 0) AS regime FROM panel")


# candidates as an axis: three of them over one read of the panel
_CHECKS = {1: lambda v: -F.col("residual_return_lag1"), 2: lambda v: F.col("residual_return_lag2"), 3: lambda v: v.select(*KEYS, (-F.log("volume")).alias("signal"))}
_REPLAY = D + f""",
lagged AS (SELECT *, lag(residual_return) OVER ({ON}) AS l1, lag(residual_return, 2) OVER ({ON}) AS l2 FROM panel),
hid AS (SELECT *, lead(residual_return) OVER ({ON}) AS ret_next FROM lagged WHERE timestamp_agg >= '2000-01-01'),
cand AS (SELECT 1 AS check_num, timestamp_agg, ticker, -l1 AS signal FROM hid UNION ALL SELECT 2, timestamp_agg, ticker, l2 FROM hid UNION ALL SELECT 3, timestamp_agg, ticker, -ln(volume) FROM hid),
sg AS (SELECT check_num, timestamp_agg, ticker, least(greatest(coalesce((signal - avg(signal) OVER b) / greatest(coalesce(stddev_samp(signal) OVER b, 0), 1e-8), 0), -4), 4) AS signal
       FROM cand WINDOW b AS (PARTITION BY check_num, timestamp_agg)),
ic AS (SELECT check_num, avg(ic) AS mean_ic FROM (SELECT check_num, timestamp_agg, avg(signal * ret_next) AS ic FROM sg JOIN hid USING (timestamp_agg, ticker) WHERE ret_next IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
cell AS (SELECT check_num, timestamp_agg, ticker, signal, residual_return AS r FROM sg JOIN hid USING (timestamp_agg, ticker) WHERE residual_return IS NOT NULL),
g AS (SELECT *, signal * CASE WHEN sum(abs(signal)) OVER b > 2 THEN 2 / sum(abs(signal)) OVER b ELSE 1 END AS w FROM cell WINDOW b AS (PARTITION BY check_num, timestamp_agg)),
grid AS (SELECT c.check_num, t.timestamp_agg, k.ticker, coalesce(g.w, 0) AS w, coalesce(g.r, 0) AS r FROM (SELECT DISTINCT check_num FROM g) c
         CROSS JOIN (SELECT DISTINCT timestamp_agg FROM g) t CROSS JOIN (SELECT DISTINCT ticker FROM g) k LEFT JOIN g USING (check_num, timestamp_agg, ticker)),
held AS (SELECT *, lag(w, 1, 0) OVER (PARTITION BY check_num, ticker ORDER BY timestamp_agg) AS w0 FROM grid),
bars AS (SELECT check_num, timestamp_agg, sum(w0 * r) AS ret FROM held GROUP BY 1, 2),
eq AS (SELECT *, 1 + sum(ret) OVER (PARTITION BY check_num ORDER BY timestamp_agg ROWS UNBOUNDED PRECEDING) AS e FROM bars),
dd AS (SELECT check_num, min(e / p - 1) AS low FROM (SELECT *, greatest(max(e) OVER (PARTITION BY check_num ORDER BY timestamp_agg ROWS UNBOUNDED PRECEDING), 1e-8) AS p FROM eq) GROUP BY 1),
day AS (SELECT check_num, timestamp_agg::DATE AS date, sum(ret) AS daily_ret FROM bars GROUP BY 1, 2),
sh AS (SELECT check_num, avg(daily_ret) * sqrt(365) / stddev_samp(daily_ret) AS sharpe FROM day GROUP BY 1)"""


def _split(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    return panel.where(F.col(TIME) < CUT_D), panel.where(F.col(TIME) >= CUT_D)


add("replay_checks", on(d, lambda p: C.replay(*_split(p), _CHECKS)[0]), "check_num:l status:s signal_rows:l mean_ic:d hidden_oos_sharpe:d hidden_oos_max_drawdown:d", _REPLAY,
    "SELECT check_num, 'completed' AS status, n AS signal_rows, mean_ic, sharpe AS hidden_oos_sharpe, low AS hidden_oos_max_drawdown FROM (SELECT check_num, count(*) AS n FROM cand GROUP BY 1) JOIN ic USING (check_num) JOIN sh USING (check_num) JOIN dd USING (check_num)")
add("replay_daily_pnl", on(d, lambda p: C.replay(*_split(p), _CHECKS)[1]), "check_num:l date:a daily_ret:d", _REPLAY, "SELECT * FROM day")


def _repeated(panel: DataFrame) -> DataFrame:
    """The candidate's rows, and those of every third bar again with another signal, seen later."""
    rows = raw(panel).withColumn("seen", F.lit(1))
    return rows.unionByName(rows.where(F.dayofyear(TIME) % 3 == 0).withColumn("signal", F.lit(1.0)).withColumn("seen", F.lit(2)))


add("backtest_repeated_keys", on(d, lambda p: B.backtest_bars(_repeated(p), order="seen")), "timestamp_agg:t gross_returns:d turnover:d gross_leverage:d equity_curve:d", _with(
    PANEL_D, f"""twice AS (SELECT timestamp_agg, ticker, -lag(residual_return) OVER ({ON}) AS signal, residual_return, 1 AS seen FROM panel
  UNION ALL SELECT timestamp_agg, ticker, 1.0, residual_return, 2 FROM panel WHERE dayofyear(timestamp_agg) % 3 = 0)""",
    "sig AS (SELECT timestamp_agg, ticker, signal FROM twice QUALIFY row_number() OVER (PARTITION BY timestamp_agg, ticker ORDER BY seen) = 1 AND signal IS NOT NULL)", BACKTEST), "SELECT * FROM bt")

_MONTHS = "(dense_rank() OVER (ORDER BY year(timestamp_agg) * 12 + month(timestamp_agg)) - 1) % 3 = 1"
add("validation_metadata", on(d, lambda p: S.validation_report(p.where(F.col(TIME) < CUT_D), S.ValidationConfig("is-month-stripe", "month", 3, 1))),
    "split:s stripe_unit:s stripe_modulus:l stripe_holdout:l stripe_basis:s train_start:t train_end:t val_start:t val_end:t train_rows:l val_rows:l",
    D + f",\nm AS (SELECT timestamp_agg AS t, {_MONTHS} AS v FROM panel WHERE timestamp_agg < '2000-01-01')",
    "SELECT 'is-month-stripe' AS split, 'month' AS stripe_unit, 3 AS stripe_modulus, 1 AS stripe_holdout, 'current_is_ordinal' AS stripe_basis, min(t) FILTER (NOT v) AS train_start, max(t) FILTER (NOT v) AS train_end, "
    "min(t) FILTER (v) AS val_start, max(t) FILTER (v) AS val_end, count(*) FILTER (NOT v) AS train_rows, count(*) FILTER (v) AS val_rows FROM m")
add("view_metadata", on(d, lambda p: K.view_report(*_split(p))), "return_mode:s safe_return_lags:s return_columns:s train_rows:l hidden_rows:l prediction_rows:l feature_rows:l", D,
    "SELECT 'null' AS return_mode, '1,2,3,6,12,24' AS safe_return_lags, 'residual_return,return' AS return_columns, count(*) FILTER (timestamp_agg < '2000-01-01') AS train_rows, "
    "count(*) FILTER (timestamp_agg >= '2000-01-01') AS hidden_rows, count(*) FILTER (timestamp_agg >= '2000-01-01') AS prediction_rows, count(*) AS feature_rows FROM panel")
tf("sliced_zscore", h, lambda p: E.over_slices(p, lambda x: x.withColumn("sliced_zscore", T.ts_zscore("volume", 20)), 19, 64, 2 * E.DAY), f"(volume - avg(volume) OVER {_TICK(19)}) / nullif(stddev_samp(volume) OVER {_TICK(19)}, 0)", H)
tf("sliced_momentum", d, lambda p: E.over_slices(p, lambda x: x.withColumn("sliced_momentum", T.momentum("close", 10)), 10, 50, 90 * E.DAY), f"close / nullif(lag(close, 10) OVER ({ON}), 0) - 1", D)
add("rolling_ic_trimmed", on(h, lambda p: G.rolling_ic(G.ic_per_bar(sc(p)), 168, True)), "timestamp_agg:t rolling_ic:d", _with(HC, IC),
    "SELECT timestamp_agg, rolling_ic FROM (SELECT *, avg(ic) OVER (ORDER BY timestamp_agg ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS rolling_ic, row_number() OVER (ORDER BY timestamp_agg) AS k, count(*) OVER () AS m FROM ic) WHERE k > least(168, m // 4)")


# peers
def _lloyd_sql(k: int, rounds: int) -> str:
    """Lloyd's rounds, one after the other, over one row per ticker."""
    parts = ['pt AS (SELECT ticker, avg("return") * 1e3 AS m, stddev_pop("return") * 1e3 AS s FROM panel WHERE "return" IS NOT NULL GROUP BY 1)',
             "rk AS (SELECT *, row_number() OVER (ORDER BY m, s, ticker) AS i, count(*) OVER () AS n FROM pt)",
             f"c0 AS (SELECT c, m, s FROM rk, (SELECT unnest(generate_series(0, {k - 1})) AS c) WHERE i = ((2 * c + 1) * n) // {2 * k} + 1)"]
    near = lambda r: f"(SELECT ticker, any_value(p.m) AS m, any_value(p.s) AS s, arg_min(c, (p.m - q.m) * (p.m - q.m) + (p.s - q.s) * (p.s - q.s)) AS c FROM pt p CROSS JOIN c{r} q GROUP BY ticker)"
    parts += [f"c{r + 1} AS (SELECT c, coalesce(a.m, b.m) AS m, coalesce(a.s, b.s) AS s FROM c{r} b LEFT JOIN (SELECT c, avg(m) AS m, avg(s) AS s FROM {near(r)} GROUP BY c) a USING (c))" for r in range(rounds)]
    return _with(*parts, f"cl AS (SELECT ticker, c AS cluster FROM {near(rounds)})")


add("cluster_peers", on(d, lambda p: N.spread(p, N.lloyd(N.return_moments(p), ["m", "s"], 4, 6), "return")), _K + "cluster:l spread:d", _with(D, _lloyd_sql(4, 6)),
    'SELECT timestamp_agg, ticker, cluster, "return" - avg("return") OVER (PARTITION BY timestamp_agg, cluster) AS spread FROM panel JOIN cl USING (ticker)')
_PEERS = D + """,
co AS (SELECT a.ticker, b.ticker AS peer, count(*) AS n, corr(a."return", b."return") AS corr FROM panel a JOIN panel b ON a.timestamp_agg = b.timestamp_agg AND a.ticker <> b.ticker
       WHERE a."return" IS NOT NULL AND b."return" IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 30),
nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY corr DESC, peer) AS place FROM co) WHERE place <= 3)"""
add("closest_peers", on(d, lambda p: N.closest_peers(p, "return", 3)), "ticker:s place:l peer:s n:l corr:d", _PEERS, "SELECT * FROM nr")
add("pair_spread", on(d, lambda p: N.pair_spread(p.select(*KEYS, "return"), N.closest_peers(p, "return"), "return")), _K + "peer:s pair_spread:d", _PEERS,
    'SELECT p.timestamp_agg, p.ticker, nr.peer, p."return" - q."return" AS pair_spread FROM panel p LEFT JOIN nr ON nr.ticker = p.ticker AND place = 1 LEFT JOIN panel q ON q.ticker = nr.peer AND q.timestamp_agg = p.timestamp_agg')
