"""Peers of a ticker: clusters by Lloyd's rounds, closest tickers by correlation in blocks, spreads against them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import NAME, TIME, is_finite
from ..sources.store import shared_dir
from .scan import DAY, slice_of

#: Decimals of a correlation by which peers are ordered: below them, equal series differ by how their sums were added up.
ORDERED = 12


def return_moments(df: DataFrame, c: str = "return", scale: float = 1e3) -> DataFrame:
    """ticker, m, s: scaled mean and deviation of each ticker's values."""
    return df.where(is_finite(c)).groupBy(NAME).agg((F.avg(c) * scale).alias("m"), (F.stddev_pop(c) * scale).alias("s"))


def lloyd(points: DataFrame, features: list[str], k: int, rounds: int = 10) -> DataFrame:
    """``points`` with cluster (from 0): Lloyd's rounds from fixed starts, so that reruns and engines agree.

    The starts are the ``k`` points at the middles of equal shares in order of the features, then ticker. A round is one
    aggregate; only the ``k`` centres come to the driver. Ties go to the lower cluster; a centre that loses all points
    stays where it is. Points with a missing feature have no cluster.
    """
    whole = reduce(lambda a, b: a & b, (is_finite(c) for c in features))
    order = Window.orderBy(*features, NAME)
    ranked = points.where(whole).select(*features, F.row_number().over(order).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("n"))
    # row numbers of the starts: floor((2 c + 1) n / (2 k)) + 1; one row per ticker meets in this window
    start = ranked.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(F.col("i") == F.floor((2 * F.col("c") + 1) * F.col("n") / (2 * k)) + 1)
    centres = [[r[f] for f in features] for r in start.orderBy("c").collect()]

    def nearest(at: list[list[float]]):
        far = [reduce(lambda a, b: a + b, ((F.col(f) - x) * (F.col(f) - x) for f, x in zip(features, c, strict=True))) for c in at]
        return F.array_min(F.array(*(F.struct(d.alias("d"), F.lit(j).alias("c")) for j, d in enumerate(far))))["c"]

    for _ in range(rounds if centres else 0):
        moved = points.where(whole).withColumn("c", nearest(centres)).groupBy("c").agg(*(F.avg(f).alias(f) for f in features)).collect()
        new = [*centres]
        for r in moved:
            new[r["c"]] = [r[f] for f in features]
        if new == centres:
            break
        centres = new
    return points.withColumn("cluster", F.when(whole, nearest(centres)) if centres else F.lit(None).cast("int"))


def spread(df: DataFrame, clusters: DataFrame, c: str) -> DataFrame:
    """``df`` with cluster and the distance of ``c`` from the mean of the bar's tickers of the same cluster."""
    d = df.join(clusters.select(NAME, "cluster"), NAME)
    return d.withColumn("spread", F.col(c) - F.avg(c).over(Window.partitionBy(TIME, "cluster")))


def correlations(df: DataFrame, c: str, block: int = 256, seconds: int = 365 * DAY, least: int = 30) -> DataFrame:
    """(ticker, peer, n, corr) of all pairs of tickers that share ``least`` bars or more, over the bars that both have.

    Tickers are dealt to blocks by hash and bars to time slices; a task multiplies two blocks over one slice and gives
    their sums, which add up over slices. So neither a ticker's history nor all tickers of a bar meet in one task.
    Pairs where a side does not vary are left out.
    """
    rows = df.where(is_finite(c)).select(F.col(NAME).alias("a"), TIME, F.col(c).cast("double").alias("x"))
    means = rows.groupBy("a").agg(F.avg("x").alias("mean"))
    blocks = max(1, -(-means.count() // block))
    rows = rows.join(means, "a").select("a", slice_of(seconds).alias("slice"), F.unix_micros(F.col(TIME).cast("timestamp")).alias("t"), (F.col("x") - F.col("mean")).alias("x"), F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int").alias("own"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other")

    def gram(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
        bars, at = np.unique(pdf["t"].to_numpy(), return_inverse=True)
        sides = []
        for k in (low, high):
            mine = (pdf["own"] == k).to_numpy()
            names, i = np.unique(pdf["a"].to_numpy(dtype=object)[mine].astype(str), return_inverse=True)
            x, m = np.zeros((len(names), len(bars))), np.zeros((len(names), len(bars)))
            x[i, at[mine]], m[i, at[mine]] = pdf["x"].to_numpy()[mine], 1.0
            sides.append((names, x, m))
        (na, x, m), (nb, y, o) = sides
        n = m @ o.T
        i, j = np.nonzero(n)
        both = {"n": n, "sx": x @ o.T, "sy": m @ y.T, "xx": (x * x) @ o.T, "yy": m @ (y * y).T, "xy": x @ y.T}
        out = pd.DataFrame({"ticker": na[i], "peer": nb[j]} | {k: v[i, j] for k, v in both.items()})
        if low == high:
            return out[out["ticker"] != out["peer"]]
        turned = out.rename(columns={"ticker": "peer", "peer": "ticker", "sx": "sy", "sy": "sx", "xx": "yy", "yy": "xx"})
        return pd.concat([out, turned[out.columns]])

    parts = dealt.groupBy("slice", "low", "high").applyInPandas(gram, "ticker string, peer string, n double, sx double, sy double, xx double, yy double, xy double")
    sums = parts.groupBy("ticker", "peer").agg(*(F.sum(k).alias(k) for k in ("n", "sx", "sy", "xx", "yy", "xy"))).where(F.col("n") >= least)
    n = F.col("n")
    vx, vy = F.col("xx") - F.col("sx") * F.col("sx") / n, F.col("yy") - F.col("sy") * F.col("sy") / n
    sums = sums.withColumn("v", vx * vy).where((vx > 1e-24) & (vy > 1e-24))
    return sums.select("ticker", "peer", n.cast("long").alias("n"), ((F.col("xy") - F.col("sx") * F.col("sy") / n) / F.sqrt("v")).alias("corr"))


def closest(pairs: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` most correlated peers of each ticker, ties by name: ticker, place (from 1), peer, n, corr."""
    order = Window.partitionBy(NAME).orderBy(F.round("corr", ORDERED).desc(), "peer")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(NAME, "place", "peer", "n", "corr")


def packed(df: DataFrame, c: str, block: int, values: int = 1 << 21) -> DataFrame:
    """Blocks of at most ``block`` tickers and about ``values`` values: id, names, counts, t (microseconds) and x (distances from the ticker's mean), the latter two as bytes.

    A ticker's values stay together. Names rise within a block; ids are unique.
    """
    all_ = Window.partitionBy("a").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.where(is_finite(c) & F.col(NAME).isNotNull()).select(F.col(NAME).alias("a"), F.unix_micros(F.col(TIME).cast("timestamp")).alias("t"), F.col(c).cast("double").alias("x"))
    # rows leave the window ticker by ticker, in time order
    rows = rows.withColumn("x", F.col("x") - F.avg("x").over(all_))
    schema = pa.schema([("id", pa.int64()), ("names", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("t", pa.binary()), ("x", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done = TaskContext.get().partitionId() << 32, 0
        names, counts, parts = [], [], []

        def row() -> pa.RecordBatch:
            t, x = (np.concatenate([p[k] for p in parts]).tobytes() for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(([first + done], [names], [counts], [t], [x]), schema, strict=True)], schema=schema)

        for batch in batches:
            a = batch.column(0).to_numpy(zero_copy_only=False)
            t, x = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1]) if len(a) else []
            for i, j in zip(starts, [*starts[1:], len(a)], strict=False):
                if not names or names[-1] != a[i]:
                    if len(names) >= block or sum(counts) >= values:
                        yield row()
                        names, counts, parts, done = [], [], [], done + 1
                    names.append(a[i])
                    counts.append(0)
                counts[-1] += int(j - i)
                parts.append((t[i:j].copy(), x[i:j].copy()))
        if names:
            yield row()

    return rows.mapInArrow(pack, "id long, names array<string>, counts array<int>, t binary, x binary")


class _Side:
    """A block's tickers, and the bars of its values as places among the bars of a pair of blocks."""

    def __init__(self, names: list[str], counts: list[int], t: bytes, x: bytes):
        self.names = np.array(names, dtype=object)
        self.row, self.t, self.x = np.repeat(np.arange(len(names)), counts), np.frombuffer(t, np.int64), np.frombuffer(x, np.float64)

    def chunk(self, at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Values and marks of what is there, ticker by bar, for bars from ``low`` up to ``high``."""
        x, there = np.zeros((len(self.names), high - low)), np.zeros((len(self.names), high - low))
        i = np.flatnonzero((at >= low) & (at < high))
        x[self.row[i], at[i] - low], there[self.row[i], at[i] - low] = self.x[i], 1.0
        return x, there


def _best(one: _Side, two: _Side, same: bool, k: int, least: int, bars: int = 2048) -> pd.DataFrame:
    """The ``k`` best peers in the other block of each ticker of two blocks; ``near`` is the correlation they are ordered by."""
    when = np.union1d(one.t, two.t)
    at, to = np.searchsorted(when, one.t), np.searchsorted(when, two.t)
    n, sx, sy, xx, yy, xy = (np.zeros((len(one.names), len(two.names))) for _ in range(6))
    for low in range(0, len(when), bars):
        high = min(low + bars, len(when))
        (x, m), (y, o) = one.chunk(at, low, high), two.chunk(to, low, high)
        n += m @ o.T
        sx += x @ o.T
        sy += m @ y.T
        xy += x @ y.T
        xx += np.square(x, out=x) @ o.T
        yy += m @ np.square(y, out=y).T
    with np.errstate(all="ignore"):
        vx, vy = xx - sx * sx / n, yy - sy * sy / n
        corr = (xy - sx * sy / n) / np.sqrt(vx * vy)
        near = np.where((n >= least) & (vx > 1e-24) & (vy > 1e-24), np.round(corr, ORDERED), -np.inf)
    if same:
        np.fill_diagonal(near, -np.inf)
    found = []
    for mine, others, rank, count, value in ((one, two, near, n, corr), *(() if same else ((two, one, near.T, n.T, corr.T),))):
        rank, i = rank.copy(), np.arange(len(mine.names))
        for _ in range(min(k, len(others.names))):
            j = rank.argmax(axis=1)  # the first of equals: names rise
            ok = rank[i, j] > -np.inf
            found.append(pd.DataFrame({"ticker": mine.names[ok], "peer": others.names[j[ok]], "n": count[i, j][ok].astype(np.int64), "corr": value[i, j][ok], "near": rank[i, j][ok]}))
            rank[i, j] = -np.inf
    return pd.concat(found)


def closest_peers(df: DataFrame, c: str, k: int = 1, block: int = 1024, least: int = 30) -> DataFrame:
    """``closest(correlations(df, c), k)`` without the rows of all pairs: ticker, place, peer, n, corr.

    All pairs are compared. Blocks of tickers are written once to the shared folder and meet in pairs (a product of that table
    with itself: nothing is copied or shuffled); a task keeps the ``k`` best of each ticker it saw. The time grows with the
    square of the tickers, what is written and shuffled does not. A task holds matrices of two blocks over 2,048 bars.
    """
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/peers-{uuid.uuid4().hex}"
    packed(df, c, block).write.option("compression", "zstd").parquet(f"{home}/blocks")
    one = spark.read.parquet(f"{home}/blocks")
    two = one.select(*(F.col(x).alias(f"{x}2") for x in one.columns))
    met = one.hint("shuffle_replicate_nl").join(two, F.col("id") <= F.col("id2"))
    kinds = pa.schema([("ticker", pa.string()), ("peer", pa.string()), ("n", pa.int64()), ("corr", pa.float64()), ("near", pa.float64())])

    def kept(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts).sort_values(["ticker", "near", "peer"], ascending=[True, False, True]).groupby("ticker").head(k)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                a, b = _Side(r["names"], r["counts"], r["t"], r["x"]), _Side(r["names2"], r["counts2"], r["t2"], r["x2"])
                parts.append(_best(a, b, r["id"] == r["id2"], k, least))
                rows += len(parts[-1])
                if rows > 100_000:
                    parts = [kept(parts)]
                    rows = len(parts[0]) // 2
        if parts:
            yield pa.RecordBatch.from_pandas(kept(parts), schema=kinds, preserve_index=False)

    # a pair of blocks is some 30 MB
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "1")
    try:
        met.mapInArrow(best, "ticker string, peer string, n long, corr double, near double").write.option("compression", "zstd").parquet(f"{home}/best")
    finally:
        spark.conf.set(batch, before)
    order = Window.partitionBy(NAME).orderBy(F.col("near").desc(), "peer")
    return spark.read.parquet(f"{home}/best").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(NAME, "place", "peer", "n", "corr")


def pair_spread(df: DataFrame, pairs: DataFrame, c: str) -> DataFrame:
    """``df`` with the closest peer and the distance of ``c`` from the peer's value at the same bar; null where either is missing.

    A ticker has one row a bar. Rows stay by ticker: only the peers' values go to the tickers that follow them, as arrays.
    """
    near, named = closest(pairs).select(F.col(NAME).alias("_of"), "peer"), F.col(NAME).isNotNull()
    rows = df.where(named & F.col(c).isNotNull()).groupBy(F.col(NAME).alias("_who")).agg(F.collect_list(F.struct(F.col(TIME).alias("at"), F.col(c).alias("value"))).alias("_rows"))
    # two plain arrays are half as large as one of pairs
    sides = F.transform("_rows", lambda r: r["at"]).alias("_at"), F.transform("_rows", lambda r: r["value"]).alias("_value")
    theirs = near.join(rows, F.col("peer") == F.col("_who"), "left").select("_of", "peer", *sides)
    # with the same filter as ``rows``, so that both read one shuffle
    mine = df.where(named).groupBy(NAME).agg(F.collect_list(F.struct(*df.columns)).alias("_mine"))
    d = mine.join(theirs, F.col(NAME) == F.col("_of"), "left")
    nothing, kind = F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema)), df.schema[c].dataType
    own = F.transform("_mine", lambda r: F.struct(F.lit(True).alias("_own"), r[TIME].alias("_at"), F.lit(None).cast(kind).alias("_value"), r.alias("_row")))
    other = F.zip_with("_at", "_value", lambda t, v: F.struct(F.lit(False).alias("_own"), t.alias("_at"), v.alias("_value"), nothing.alias("_row")))
    d = d.select(F.col(NAME).alias("_of"), "peer", F.inline(F.concat(own, F.coalesce(other, F.slice(own, 1, 0)))))
    d = d.withColumn("_value", F.max("_value").over(Window.partitionBy("_of", "_at"))).where("_own")
    out = d.select("_row.*", "peer", "_value").select(*df.columns, "peer", (F.col(c) - F.col("_value")).alias("pair_spread"))
    unnamed = df.where(~named)
    return out.unionByName(unnamed.select(*df.columns, F.lit(None).cast(out.schema["peer"].dataType).alias("peer"), F.lit(None).cast(out.schema["pair_spread"].dataType).alias("pair_spread")))
