"""SQL text shared by the oracles: the same derivations as common table expressions."""

from __future__ import annotations

PANEL_D = """base AS (
  SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS timestamp_agg, 'S' || l_suppkey::VARCHAR AS ticker,
         sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume, count(*) AS n_obs
  FROM lineitem GROUP BY 1, 2),
r0 AS (SELECT *, 0.01 * ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY timestamp_agg)) AS "return" FROM base),
panel AS (SELECT *, "return" - avg("return") OVER (PARTITION BY timestamp_agg) AS residual_return FROM r0)"""
PANEL_H = """base AS (
  SELECT date_trunc('hour', ts)::TIMESTAMP AS timestamp_agg, event_type AS ticker, avg(value) AS close, sum(value) AS volume,
         count(*) AS n_obs, avg(nullif(regexp_extract(props, '(-?[0-9]+(\\.[0-9]+)?)', 1), '')::DOUBLE) / 1e4 AS funding_rate
  FROM events GROUP BY 1, 2),
r0 AS (SELECT *, 0.01 * ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY timestamp_agg)) AS "return" FROM base),
panel AS (SELECT *, "return" - avg("return") OVER (PARTITION BY timestamp_agg) AS residual_return FROM r0)"""
SIGNAL = """raw AS (SELECT timestamp_agg, ticker, -lag(residual_return) OVER (PARTITION BY ticker ORDER BY timestamp_agg) AS signal FROM panel),
sig AS (SELECT timestamp_agg, ticker, least(greatest(coalesce((signal - avg(signal) OVER b)
          / greatest(coalesce(stddev_samp(signal) OVER b, 0), 1e-8), 0), -4), 4) AS signal
        FROM raw WINDOW b AS (PARTITION BY timestamp_agg))"""
SCORED = """nxt AS (SELECT timestamp_agg, ticker, residual_return AS ret, lead(residual_return) OVER (PARTITION BY ticker ORDER BY timestamp_agg) AS ret_next FROM panel),
sc AS (SELECT s.timestamp_agg, s.ticker, s.signal, n.ret, n.ret_next FROM sig s JOIN nxt n USING (timestamp_agg, ticker))"""
IC = "ic AS (SELECT timestamp_agg, avg(signal * ret_next) AS ic, count(*) AS n FROM sc WHERE ret_next IS NOT NULL GROUP BY 1)"
BACKTEST = """cell AS (SELECT s.timestamp_agg, s.ticker, s.signal, p.residual_return AS r FROM sig s JOIN panel p USING (timestamp_agg, ticker) WHERE p.residual_return IS NOT NULL),
g AS (SELECT *, signal * CASE WHEN sum(abs(signal)) OVER b > 2.0 THEN 2.0 / greatest(sum(abs(signal)) OVER b, 1e-8) ELSE 1.0 END AS w
      FROM cell WINDOW b AS (PARTITION BY timestamp_agg)),
grid AS (SELECT t.timestamp_agg, k.ticker, coalesce(g.w, 0) AS w, coalesce(g.r, 0) AS r
         FROM (SELECT DISTINCT timestamp_agg FROM g) t CROSS JOIN (SELECT DISTINCT ticker FROM g) k LEFT JOIN g USING (timestamp_agg, ticker)),
st AS (SELECT *, lag(w, 1, 0) OVER (PARTITION BY ticker ORDER BY timestamp_agg) AS w0 FROM grid),
po AS (SELECT *, sum(w0 * r) OVER (PARTITION BY timestamp_agg) AS port FROM st),
ba AS (SELECT timestamp_agg, max(port) AS gross_returns, sum(abs(w - w0 * (1 + r) / greatest(1 + port, 1e-8))) / 2 AS traded, sum(abs(w0)) AS gross_leverage
       FROM po GROUP BY 1),
bt AS (SELECT timestamp_agg, gross_returns, gross_returns AS net_ret,
              CASE WHEN row_number() OVER (ORDER BY timestamp_agg) = 1 THEN 0 ELSE traded END AS turnover, gross_leverage,
              1 + sum(gross_returns) OVER (ORDER BY timestamp_agg ROWS UNBOUNDED PRECEDING) AS equity_curve FROM ba),
daily AS (SELECT timestamp_agg::DATE AS date, sum(net_ret) AS daily_ret FROM bt GROUP BY 1)"""
STREAMS = """lags AS (SELECT timestamp_agg, ticker, residual_return, "return", k,
    CASE k WHEN 1 THEN lag(residual_return, 1) OVER o WHEN 2 THEN lag(residual_return, 2) OVER o ELSE lag(residual_return, 3) OVER o END AS past
  FROM panel CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) WINDOW o AS (PARTITION BY k, ticker ORDER BY timestamp_agg)),
streams AS (SELECT 'T' || (right(ticker, 1)::INT % 4)::VARCHAR AS task, m AS model, k AS attempt, timestamp_agg::DATE AS date,
    avg(-past * CASE m WHEN 'A' THEN residual_return ELSE "return" END * 1e4) AS daily_ret
  FROM lags CROSS JOIN (SELECT unnest(['A', 'B']) AS m) WHERE past IS NOT NULL GROUP BY 1, 2, 3, 4),
unit AS (SELECT *, coalesce(daily_ret / nullif(stddev_samp(daily_ret) OVER (PARTITION BY task, model, attempt), 0), 0) AS unit_ret FROM streams)"""


def corr(x: str, y: str) -> str:
    """Correlation over rows that have both; 0 where a side is constant."""
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"coalesce(covar_pop({x}, {y}) / nullif(CASE WHEN stddev_pop({a}) * stddev_pop({b}) > 1e-15 THEN stddev_pop({a}) * stddev_pop({b}) END, 0), 0)"


def average_rank(x: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"


def bucket(x: str, by: str, n: int) -> str:
    """Number of equal-probability breaks of the group below x (the breaks come from a join on the group)."""
    return " + ".join(f"({x} > quantile_cont({x}, {k / n}) OVER (PARTITION BY {by}))::INT" for k in range(1, n))
