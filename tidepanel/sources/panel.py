"""Panels keyed by (timestamp_agg, ticker): derived from the star-schema tables, read from task folders, written."""

from __future__ import annotations

import json
import math
import tomllib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import NAME, TIME, bar, own
from . import store
from .bundle import hashes

ALIASES = ("timestamp", "timestamp_agg", "date", "datetime")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_returns(panel: DataFrame) -> DataFrame:
    """Scaled log return of a ticker's close and its distance from the bar's mean; null on first rows."""
    out = panel.withColumn("return", 0.01 * F.log(F.col("close") / F.lag("close").over(own())))
    return out.withColumn("residual_return", F.col("return") - F.avg("return").over(bar()))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly panel of event types."""
    k = F.regexp_extract("props", r"(-?\d+(\.\d+)?)", 1)
    rows = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias(TIME), F.col("event_type").alias(NAME)).agg(
        F.avg("value").alias("close"), F.sum("value").alias("volume"), F.count(F.lit(1)).alias("n_obs"),
        (F.avg(F.when(k != "", k).cast("double")) / 1e4).alias("funding_rate"),
    )
    return with_returns(rows)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily panel of suppliers. Rows are dealt by supplier once, for the aggregate and the windows along suppliers."""
    rows = table(spark, sf_dir, "lineitem").select(F.date_trunc("day", F.col("l_shipdate").cast("timestamp")).alias(TIME), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias(NAME), "l_extendedprice", "l_quantity")
    rows = rows.repartition(F.col(NAME)).groupBy(TIME, NAME).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"), F.count(F.lit(1)).alias("n_obs")
    )
    return with_returns(rows)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet file, or no rows where there is none."""
    try:  # any store that Spark reads
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def timestamp_column(df: DataFrame) -> str:
    found = next((c for c in ALIASES if c in df.columns), None)
    if found is None:
        raise ValueError(f"no timestamp column among {df.columns}")
    return found


def full_frame(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both periods by name (missing columns null), equal rows once."""
    return train.unionByName(test, allowMissingColumns=True).distinct()


def full_of(df: DataFrame, *parts: Column) -> DataFrame:
    """``full_frame`` of parts of one frame. The frame is computed once for all of them: computed twice, sums of doubles may
    differ in their last bits by the order of rows, and a row that two parts share would count twice.
    """
    which = F.array_compact(F.array(*(F.when(p, F.lit(k)) for k, p in enumerate(parts))))
    return df.withColumn("_part", F.explode(which)).drop("_part").distinct()


TRAIN, TEST, VAL = "environment/data/train.parquet", "tests/test.parquet", "tests/val.parquet"


def read_task(spark: SparkSession, task: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, full) of a task folder in any store."""
    paths = [f"{task.rstrip('/')}/{p}" for p in (TRAIN, TEST)]
    for p in paths:
        if not store.exists(spark, p):
            raise FileNotFoundError(p)
    train, test = (spark.read.parquet(p) for p in paths)
    full = full_frame(train, test)
    return train, test, full.orderBy(timestamp_column(full))


def tasks(spark: SparkSession, root: str, names: str | None = None) -> list[str]:
    """Task folders below ``root`` (also for "all"), or those of a comma-separated list, sorted."""
    if names and names != "all":
        return sorted(n.strip() for n in names.split(",") if n.strip())
    return store.folders(spark, root, "signal-*")


def load_profile(spark: SparkSession, path: str) -> dict:
    return tomllib.loads(store.read_text(spark, path))


def plain(x):
    """JSON-ready values: dates as text, numpy scalars unwrapped, non-finite numbers as null."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if hasattr(x, "item"):
        x = x.item()
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return None if isinstance(x, float) and not math.isfinite(x) else x


def write_json(spark: SparkSession, path: str, value: dict | list) -> None:
    """JSON with sorted keys, put in place at once, in any store."""
    store.write_text(spark, path, json.dumps(plain(value), indent=2, sort_keys=True) + "\n")


def checksums(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """name (path below the folder), size and SHA-256 of each file below a folder; tasks hash files in blocks."""
    return hashes(spark, folder, glob)


def compare_checksums(there: DataFrame, expected: DataFrame) -> DataFrame:
    """Files that are missing or differ."""
    both = expected.alias("e").join(there.alias("t"), "name", "left")
    return both.where(F.col("t.sha256").isNull() | (F.col("t.sha256") != F.col("e.sha256"))).select("name", F.when(F.col("t.sha256").isNull(), "missing").otherwise("mismatch").alias("problem"))
