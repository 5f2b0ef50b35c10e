"""Cross-sectional scores of a stream, bar by bar (Structured Streaming; the same code runs on a batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EPS, NAME, TIME, clip


def bar_scores(rows: DataFrame, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(timestamp_agg, ticker, value, score): mean of each ticker in each bar, and its z-score within +-4 in the bar.

    Two stateful aggregations in append mode: by bar and ticker, then by bar. A bar is emitted once the
    watermark has passed it; rows later than ``late`` are left out. State is one row per open bar and
    ticker. Null values count for nothing; a bar of one ticker, or of equal values, scores 0.
    """
    rows = rows.where(F.col(TIME).isNotNull() & F.col(value).isNotNull()).withWatermark(TIME, late)
    each = rows.groupBy(F.window(TIME, width).alias("bar"), NAME).agg(F.avg(value).alias("value"))
    bars = each.groupBy(F.window(F.window_time("bar"), width).alias("bar")).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("spread"), F.collect_list(F.struct(NAME, "value")).alias("members")
    )
    z = (F.col("m.value") - F.col("mean")) / F.greatest(F.coalesce("spread", F.lit(0.0)), F.lit(EPS))
    return bars.select("bar", "mean", "spread", F.explode("members").alias("m")).select(
        F.col("bar.start").alias(TIME), F.col(f"m.{NAME}").alias(NAME), F.col("m.value").alias("value"), clip(z, -4.0, 4.0).alias("score")
    )
